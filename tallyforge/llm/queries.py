"""The registered queries of the text operators and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bestfit, decontaminate, dialogue, langid, linededup, phrases, pii, quality, sharding, simhash, tokenbin, toxicity
from .shared import held_out, table


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    classes = simhash.near_duplicate_classes(table(spark, folder, "documents"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and its edits."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.find_leaks(docs, table(spark, folder, "benchmark"))


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Importance weights of all documents against those labelled good, and the sample drawn by them."""
    good = table(spark, folder, "labels").where("quality = 1").select("doc_id")
    return quality.resample(table(spark, folder, "documents"), good)


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity scores of all documents, learned from labels that aren't held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").where(~held_out(F.col("doc_id"), 5, 0))
    scored = toxicity.fit(docs, labels).score(docs)
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and span digests of personal data in all documents."""
    found = pii.find_pii(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.flatten(F.array(*[F.col(f"pii_{k}") for k in pii.BASE]))
    whole = F.flatten(F.array(*[F.col(f"pii_{k}") for k in pii.PATTERNS]))
    counts = [F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in pii.BASE]
    secrets = sum((F.size(f"pii_{k}").cast("long") for k in pii.SECRETS), F.lit(0).cast("long"))
    more = secrets.alias("n_secret"), F.size(whole).cast("long").alias("n_spans"), pii.scores(whole).alias("span_scores")
    return found.select("doc_id", *counts, F.sha2(pii.digest(base), 256).alias("base_sha256"), pii.digest(whole).alias("spans"), *more)


def op6_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector."""
    return ann.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the number of boilerplate lines dropped and the hash of what is left."""
    out = linededup.drop_boilerplate(table(spark, folder, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "source", "dropped_lines", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


OP7_SQL = f"""
WITH totals AS (SELECT source, count(*) AS site_pages FROM documents WHERE source IS NOT NULL GROUP BY source),
lines AS (SELECT source, unnest(list_distinct([trim(x, ' ' || chr(9) || chr(13)) FOR x IN string_split(coalesce(text, ''), chr(10))])) AS line FROM documents),
counted AS (SELECT source, line, count(*) AS n_pages FROM lines WHERE line <> '' GROUP BY source, line),
per_site AS (
  SELECT c.source, list(c.line) AS drops FROM counted c JOIN totals t ON t.source = c.source
  WHERE c.n_pages > 1 AND c.n_pages > {linededup.RATIO}::DOUBLE * t.site_pages GROUP BY c.source),
cut AS (
  SELECT d.doc_id, d.source, string_split(d.text, chr(10)) AS parts,
    list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(coalesce(s.drops, []), trim(x, ' ' || chr(9) || chr(13)))) AS kept
  FROM documents d LEFT JOIN per_site s ON s.source = d.source)
SELECT doc_id, source, coalesce(len(parts) - len(kept), 0)::BIGINT AS dropped_lines,
  length(array_to_string(kept, chr(10)))::BIGINT AS kept_chars, md5(array_to_string(kept, chr(10))) AS kept_md5 FROM cut
"""


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return bestfit.pack_documents(table(spark, folder, "documents"))


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of all documents, learned from those that aren't held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 3, 1)
    scored = langid.predict(docs, langid.fit(docs.where(~out)))
    return scored.select("doc_id", out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op10_token_rows(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as packed rows of 2048 token ids."""
    return tokenbin.pack_rows(table(spark, folder, "documents"))


SHARDS, SHUFFLE_SEED = 24, 11


def op11_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document in a reproducible shuffle: 24 shards whose numbers of rows are at most one apart."""
    sizes = sharding.shard_sizes(table(spark, folder, "documents"))
    placed = sharding.assign(sizes, ("doc_id", "size", "text_crc32"), SHARDS, SHUFFLE_SEED)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The 2000 best phrases of every language."""
    return phrases.collocations(table(spark, folder, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
sizes AS (SELECT unnest([1, 2, 3, 4]) AS k),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM words, sizes WHERE len(w) >= k),
counts AS (SELECT lang, k, phrase, count(*)::BIGINT AS a FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 30),
cuts AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM counts WHERE k > 1),
each AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a) // (x.a + y.a) AS score FROM cuts c
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:c.k], ' ')),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM each),
longer AS (SELECT lang, k, a, string_split(phrase, ' ') AS w FROM counts WHERE k > 2),
inside AS (
  SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM longer, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS i) WHERE m < k AND i + m - 1 <= k),
hidden AS (SELECT lang, phrase, max(a) AS longest FROM inside GROUP BY lang, phrase),
ranked AS (
  SELECT e.lang, row_number() OVER (PARTITION BY e.lang ORDER BY e.score DESC, e.a DESC, e.phrase) AS rank, e.phrase, e.a, e.l, e.r, e.score::BIGINT AS score
  FROM lowest e LEFT JOIN hidden h ON h.lang = e.lang AND h.phrase = e.phrase WHERE e.place = 1 AND coalesce(100 * h.longest < 80 * e.a, true))
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""


def op13_dialogue(spark: SparkSession, folder: str) -> DataFrame:
    """The cheapest repair of every damaged conversation."""
    return dialogue.summaries(dialogue.damaged(table(spark, folder, "conversations")), "present")


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_decontamination": op2_decontamination,
    "op3_quality": op3_quality,
    "op4_toxicity": op4_toxicity,
    "op5_pii": op5_pii,
    "op6_neighbours": op6_neighbours,
    "op7_line_dedup": op7_line_dedup,
    "op8_packing": op8_packing,
    "op9_language_id": op9_language_id,
    "op10_token_rows": op10_token_rows,
    "op11_sharding": op11_sharding,
    "op12_phrases": op12_phrases,
    "op13_dialogue": op13_dialogue,
}
ORACLES = {"op7_line_dedup": OP7_SQL, "op12_phrases": OP12_SQL}
