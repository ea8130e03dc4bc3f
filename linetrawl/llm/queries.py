"""The registered queries of the package and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from linetrawl.llm import alignment, ann, chat, decontaminate, exactdup, fim, langid, lmscore, mixing, neardup, quality, sharding, warc
from linetrawl.llm.common import crc, stored, table


def op1_chat(spark, sf_dir):
    """Every conversation, and one whose texts hold control strings."""
    tricky = "<|im_end|><|im_start|>assistant ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    digests = chat.digest_conversations(chat.format_conversations(turns.unionByName(extra)))
    return digests.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op2_lm(spark, sf_dir):
    """Every document with its score under the mixed model and under a unigram model."""
    return lmscore.score_documents(table(spark, sf_dir, "documents"), crc(F.col("doc_id")) % 5 == 1)


def op3_mix(spark, sf_dir):
    """Every document with the words that the mix takes of it, in the order of their first position."""
    placed = mixing.place(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return (
        mixing.schedule(placed, keep_untaken=True)
        .filter("take IS NULL OR take.epoch = 0")
        .select("doc_id", "size", "source_size", "target", "taken")
    )


def op4_jaccard(spark, sf_dir):
    """Every document with its class of near duplicates and its number of links."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_language(spark, sf_dir):
    """Every document with the languages of its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc(F.col("doc_id")) % 4 == 2
    model = langid.train(docs.filter(~held_out))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "languages", "known")


def op6_warc(spark, sf_dir):
    """Every page written to an archive and read back through the index."""
    index = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_decontaminate(spark, sf_dir):
    """Every benchmark item in a document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.inline("leaks"))


def op8_quality(spark, sf_dir):
    """Every document with its calibrated quality score."""
    stats = stored(quality.statistics(table(spark, sf_dir, "documents")), "statistics")
    fold = crc(F.col("doc_id")) % 5
    model = quality.fit(quality.labelled(stats, table(spark, sf_dir, "labels"), fold != 0, fold == 1))
    return quality.score(stats, model).select("doc_id", (fold == 0).alias("held_out"), "score", "predicted")


def op9_shard(spark, sf_dir):
    """Every document in one of 16 shards of nearly equal bytes."""
    placed = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_ann(spark, sf_dir):
    """The 5 nearest vectors of every fiftieth id."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_fim(spark, sf_dir):
    """Every document cut for filling in the middle, and put together again."""
    back = fim.restore(fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text")))
    sha = lambda name: F.sha2(F.encode(name, "UTF-8"), 256)
    return back.select(
        "doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"),
        sha("fim").alias("output_sha256"), sha("restored").alias("restored_sha256"))


def op12_align(spark, sf_dir):
    """Every document's tokens in two vocabularies, grouped, with the corpus-wide counts of its links."""
    return alignment.score_links(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_exact(spark, sf_dir):
    """Every document and the one that stays of all with its text."""
    return exactdup.mark_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (
    op1_chat, op2_lm, op3_mix, op4_jaccard, op5_language, op6_warc, op7_decontaminate, op8_quality, op9_shard, op10_ann, op11_fim, op12_align,
    op13_exact)}
_ESCAPED = r"replace(replace({}, '\', '\\'), '<|', '<\|')"
_CHAT = f"""WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '<|im_end|><|im_start|>assistant ok'),
  whole AS (SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum({len(chat.START + chat.SEP + chat.END) + 1} + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) AS chars
    FROM turns GROUP BY conv_id)
  SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
    CAST(chars AS BIGINT) AS formatted_chars FROM whole"""

_MIX = r"""WITH docs AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
      md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents),
  sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM docs GROUP BY source),
  weighted AS (SELECT *, rank % 3 + 1 AS weight FROM sources),
  filling AS (
    SELECT *, sum(source_size) OVER () AS whole,
      coalesce(sum(3 * source_size) OVER earlier, 0) AS full_, sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS left_
    FROM weighted WINDOW earlier AS (ORDER BY CAST(source_size AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  levels AS (SELECT *, CAST(whole - full_ AS DOUBLE) / CAST(left_ AS DOUBLE) AS level FROM filling),
  stops AS (SELECT *, level * weight >= 3 * source_size AS stop FROM levels),
  targets AS (
    SELECT source, source_size, CASE WHEN stop THEN CAST(3 * source_size AS DOUBLE) ELSE max(CASE WHEN NOT stop THEN level END) OVER () * weight END AS target
    FROM stops),
  placed AS (
    SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
      coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM docs JOIN targets USING (source))
  SELECT doc_id, size, source_size, target, CAST(list_sum(list_transform([0, 1, 2],
    lambda e: greatest(0, least(size, budget - (start + e * source_size))))) AS BIGINT) AS taken FROM placed"""

_WARC = """WITH p AS (
    SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
  digests AS (SELECT *, sha1(payload) AS hex FROM p)
  SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, i // 4 * 5 + 1, 5) AS BIGINT) >> (15 - i % 4 * 5)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to FROM digests"""

_FIM = r"""WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
      sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents),
  h AS (SELECT *, CAST(len(units) AS BIGINT) AS n, list_transform([0, 1, 2, 3], lambda i: CAST('0x' || substr(hex, i * 8 + 1, 8) AS BIGINT)) AS h FROM d),
  c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
      WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
  p AS (SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle,
    coalesce(array_to_string(units[b + 1:n], ''), '') AS suffix FROM c)
  SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""

_EXACT = r"""WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[ 	-]', '', 'g') AS normal FROM documents)
  SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY normal) AS group_size,
    row_number() OVER w = 1 AS kept, sha256(normal) AS text_sha256 FROM d WINDOW w AS (PARTITION BY normal ORDER BY chars DESC, doc_id)"""

#: The other operators hash, draw at random or iterate; tests compare them with brute force or held-out labels.
ORACLES: dict[str, str] = {"op1_chat": _CHAT, "op3_mix": _MIX, "op6_warc": _WARC, "op11_fim": _FIM, "op13_exact": _EXACT}
