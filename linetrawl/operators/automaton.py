"""Thousands of keywords in one pass over a text: an Aho-Corasick automaton as tables, run over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Table cells (states x character classes) of one automaton; more keywords make more automata.
CELLS = 1 << 24
#: Texts run side by side in pieces of this many characters, so the steps do not depend on the length of a text.
PIECE = 192
#: Characters worked on at a time.
CHUNK = 1 << 21


class Automaton:
    """Every occurrence of distinct, non-empty ``words``, overlapping ones included.

    A state is a prefix of some word. ``step[state, class]`` is the longest prefix that ends the text after one more
    character; failure links are folded into it, level by level, so matching never follows one. Characters in no word share
    class 0. ``word[state]`` is the word that ends in a state or -1, ``shorter[state]`` the next state down the failure
    links where a word ends, 0 if none does.
    """

    def __init__(self, words: list[str]):
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.alphabet = np.unique(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32))
        known = {chr(c): i + 1 for i, c in enumerate(self.alphabet.tolist())}
        children: list[dict[int, int]] = [{}]
        ends = []
        for text in words:
            at = 0
            for char in text:
                below = children[at]
                cls = known[char]
                at = below.get(cls) or below.setdefault(cls, len(children))
                if at == len(children):
                    children.append({})
            ends.append(at)
        self.word = np.full(len(children), -1, np.int64)
        self.word[ends] = np.arange(len(words))
        self.step = np.zeros((len(children), len(self.alphabet) + 1), np.int32)
        self.shorter = np.zeros(len(children), np.int32)
        self._link(children)
        self.ending = (self.word >= 0) | (self.shorter > 0)

    def _link(self, children):
        fail = np.zeros(len(children), np.int32)
        level = [0]
        while level:
            states = np.array(level)
            edges = [(s, cls, child) for s in level for cls, child in children[s].items()]
            # A state without a child of its own goes where its failure goes; the root stays.
            self.step[states] = self.step[fail[states]]
            if edges:
                parent, cls, child = (np.array(x) for x in zip(*edges))
                below = np.where(parent == 0, 0, self.step[fail[parent], cls])
                fail[child] = below
                self.step[parent, cls] = child
                self.shorter[child] = np.where(self.word[below] >= 0, below, self.shorter[below])
            level = [child for _, _, child in edges]

    def classes(self, points: np.ndarray) -> np.ndarray:
        """Character classes of code points."""
        at = np.searchsorted(self.alphabet, points)
        at[at == len(self.alphabet)] = 0
        return np.where(self.alphabet[at] == points, at + 1, 0)

    def run(self, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(end, word)`` of every occurrence inside the texts that begin at ``starts`` in ``points``, in no particular order."""
        longest = int(self.lengths.max(initial=1))
        size = max(PIECE, 4 * longest)
        limits = np.append(starts[1:], len(points))
        counts = -(-(limits - starts) // size)
        text = np.repeat(np.arange(len(starts)), counts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
        first = starts[text] + nth * size
        stop = np.minimum(first + size, limits[text])
        begin = np.maximum(first - (longest - 1), starts[text])  # a word may begin before the piece that it ends in
        order = np.argsort(begin - stop, kind="stable")  # longest first: pieces that are done drop off the end
        first, stop, begin = first[order], stop[order], begin[order]
        widths = self.step.shape[1]
        flat, state = self.step.ravel(), np.zeros(len(begin), np.int64)
        live = np.searchsorted(begin - stop, -np.arange(int((stop - begin).max(initial=0))), "left").tolist()
        found_at, found_in = [], []
        for t, n in enumerate(live):
            at = begin[:n] + t
            now = flat[state[:n] * widths + self.classes(points[at])].astype(np.int64)
            state[:n] = now
            hit = np.flatnonzero(self.ending[now] & (at >= first[:n]))
            if len(hit):
                found_at.append(at[hit] + 1)
                found_in.append(now[hit])
        if not found_at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, states = np.concatenate(found_at), np.concatenate(found_in)
        ends, words = [], []
        while len(states):
            named = self.word[states] >= 0
            ends.append(at[named])
            words.append(self.word[states[named]])
            states = self.shorter[states].astype(np.int64)
            at, states = at[states > 0], states[states > 0]
        return np.concatenate(ends), np.concatenate(words)


class Keywords:
    """Distinct normalised keywords as one or more automata, built once and shared by all tasks.

    ``places`` are the places of the keywords in the list that was given, ``repeats`` of them for each distinct one.
    """

    def __init__(self, norms: list[tuple[int, str]]):
        places: dict[str, list[int]] = {}
        for number, norm in norms:
            places.setdefault(norm, []).append(number)
        self.words = sorted(places)  # words that begin alike share states, so they stay together
        self.places = np.array([n for w in self.words for n in places[w]], np.int64)
        self.repeats = np.array([len(places[w]) for w in self.words], np.int64)
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        #: Whether a keyword can overlap itself; only then may an occurrence be barred by an earlier one.
        self.bordered = np.array([any(w.startswith(w[i:]) for i in range(1, len(w))) for w in self.words], bool)
        self.automata: list[tuple[int, Automaton]] = []
        for begin, end in self._blocks():
            self.automata.append((begin, Automaton(self.words[begin:end])))

    def _blocks(self) -> Iterator[tuple[int, int]]:
        begin, states, chars, before = 0, 1, set(), ""
        for i, word in enumerate(self.words):
            shared = 0
            while shared < min(len(word), len(before)) and word[shared] == before[shared]:
                shared += 1
            grown = chars | set(word)
            if i > begin and (states + len(word) - shared) * (len(grown) + 1) > CELLS:
                yield begin, i
                begin, states, grown, shared = i, 1, set(word), 0
            states, chars, before = states + len(word) - shared, grown, word
        if self.words:
            yield begin, len(self.words)

    def occurrences(self, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(position, word)`` of every occurrence in the texts that begin at ``starts``, overlapping ones included."""
        positions, words = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for first, automaton in self.automata:
            ends, found = automaton.run(points, starts)
            positions.append(ends - automaton.lengths[found])
            words.append(found + first)
        return np.concatenate(positions), np.concatenate(words)

    def listed(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences, one for each place of their keyword in the list: which occurrence, which place."""
        many = self.repeats[words]
        which = np.repeat(np.arange(len(words)), many)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        return which, self.places[(np.cumsum(self.repeats) - self.repeats)[words[which]] + nth]

    def apart(self, text: np.ndarray, positions: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Sorted by text, keyword and position: which occurrences are met when each keyword is sought from
        the end of its last occurrence on."""
        kept = np.ones(len(words), bool)
        doubtful = np.flatnonzero(self.bordered[words])
        last = (-1, -1)
        free = 0
        for i, t, w, p in zip(doubtful.tolist(), text[doubtful].tolist(), words[doubtful].tolist(), positions[doubtful].tolist()):
            if (t, w) != last:
                last, free = (t, w), 0
            kept[i] = p >= free
            if kept[i]:
                free = p + int(self.lengths[w])
        return kept


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, laid end to end, and where each begins."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return points, np.cumsum(sizes) - sizes
