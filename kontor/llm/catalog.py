"""Registered queries of the operators, each over its whole table, and the DuckDB text where SQL can tell the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.llm import codes, decontaminate, licenses, lines, mixing, pii, quality, separators, simhash, substring, toxicity, whitening, wrapper
from kontor.llm.tables import read
from kontor.session import checkpoint_cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query("op1_pseudonyms")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read(spark, sf_dir, "documents"))


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.count_tokens(read(spark, sf_dir, "documents"))


_LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS line_no, s[i] AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)
), w AS (
  SELECT doc_id, line_no, list_distinct(regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+')) AS k FROM l
), c AS (
  SELECT list_sort(k) AS k, len(k) AS n, min((doc_id, line_no)) AS p FROM w WHERE len(k) > 0 GROUP BY ALL
), t AS (
  SELECT p, n, unnest(k) AS token FROM c
), f AS (
  SELECT token, count(*) AS df FROM t GROUP BY token
), o AS (
  SELECT p, n, token, row_number() OVER (PARTITION BY p ORDER BY df, token) AS i FROM t JOIN f USING (token)
), x AS (
  SELECT p, n, token FROM o WHERE i <= n - CAST(ceil(n * 4 / 5) AS BIGINT) + 1
), pairs AS (
  SELECT DISTINCT a.p AS pa, b.p AS pb FROM x a JOIN x b USING (token) WHERE a.p < b.p AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
), later AS (
  SELECT DISTINCT pb FROM pairs JOIN c a ON a.p = pa JOIN c b ON b.p = pb
  WHERE 5 * len(list_intersect(a.k, b.k)) >= 4 * (a.n + b.n - len(list_intersect(a.k, b.k)))
), gone AS (
  SELECT w.doc_id, w.line_no FROM w JOIN c ON c.k = list_sort(w.k)
  WHERE (w.doc_id, w.line_no) <> c.p OR c.p IN (SELECT pb FROM later)
)
SELECT d.doc_id, CAST(len(string_split(d.text, chr(10))) AS BIGINT) AS n_lines, count(line_no) AS n_removed,
  coalesce(string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no), '') AS removed
FROM documents d LEFT JOIN gone ON gone.doc_id = d.doc_id GROUP BY d.doc_id, d.text
"""


@query("op3_similar_lines", _LINES_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.report(read(spark, sf_dir, "documents"))
    return found.withColumn("removed", F.array_join("removed", ","))


@query("op4_simhash_duplicates")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@query("op5_licences")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", *(F.array_join(c, ",").alias(c) for c in ("sentences", "licences")))


@query("op6_decontaminate")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op7_main_text")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_text(read(spark, sf_dir, "pages"))


_WINDOWS_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)
), least AS (
  SELECT gram, min(doc_id) AS first_doc FROM g GROUP BY gram HAVING min(doc_id) < max(doc_id)
), bad AS (
  SELECT DISTINCT g.doc_id, unnest(generate_series(i, i + 12)) AS p FROM g JOIN least USING (gram) WHERE g.doc_id > first_doc
), words AS (
  SELECT doc_id, unnest(generate_series(1, len(w))) AS p, unnest(w) AS word FROM d WHERE len(w) > 0
), kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS t, count(*) AS n
  FROM words ANTI JOIN bad ON words.doc_id = bad.doc_id AND words.p = bad.p GROUP BY words.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query("op8_repeated_spans", _WINDOWS_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = substring.repeated_spans(read(spark, sf_dir, "documents"))
    return spans.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_quality_outliers")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents")).drop("distance")


_MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS n FROM d GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][CAST((n - 1) % 3 + 1 AS BIGINT)] AS weight, 2 * source_size AS cap FROM s
), a AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - (sum(cap) OVER f - cap))::DOUBLE / (sum(weight) OVER () - (sum(weight) OVER f - weight))::DOUBLE AS asked
  FROM w WINDOW f AS (ORDER BY cap::DOUBLE / weight, n)
), t AS (
  SELECT source, source_size, n, least(cap::DOUBLE, max(asked) OVER () * weight) AS target FROM a
), b AS (
  SELECT *, sum(blocks) OVER () AS m, sum(blocks) OVER (ORDER BY n)::DOUBLE / nullif(sum(blocks) OVER (), 0)::DOUBLE AS high FROM (
    SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS words, CAST(ceil(floor(target + 0.5) / 64) AS BIGINT) AS blocks FROM t)
), i AS (
  SELECT *, coalesce(lag(high) OVER (ORDER BY n), 0) AS low FROM b
), v AS (
  SELECT slot, list_sum(list_transform(generate_series(0, 47), lambda k: ((slot >> k) & 1) * pow(2, -1 - k))) AS u
  FROM (SELECT unnest(generate_series(0, CAST((SELECT max(m) FROM b) AS BIGINT) - 1)) AS slot)
), g AS (
  SELECT n, row_number() OVER (PARTITION BY n ORDER BY slot) - 1 AS rank, slot, blocks FROM v JOIN i ON u >= low AND u < high
), e AS (
  SELECT n, rank, slot FROM g WHERE rank < blocks
  UNION ALL
  SELECT n, rank, CAST(m AS BIGINT) + rank FROM (
    SELECT i.n, any_value(m) AS m, unnest(generate_series(count(g.slot), any_value(i.blocks) - 1)) AS rank FROM i LEFT JOIN g ON g.n = i.n GROUP BY i.n)
), o AS (
  SELECT d.doc_id, d.size, b.n, b.source_size, b.target, words,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS LAST, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(size, words - pos)) + greatest(0, least(size, words - source_size - pos)) AS BIGINT) AS taken, CAST(slot AS BIGINT) AS first_slot
FROM o LEFT JOIN e ON e.n = o.n AND e.rank = o.pos // 64 AND o.size > 0 AND o.pos < o.words
"""


@query("op10_source_mix", _MIX_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


@query("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(read(spark, sf_dir, "embeddings"))
    each = found.select("*", F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "value"))
    return each.select(
        "vec_id", (F.col("place") + 1).alias("component"), "n", "deviation",
        F.col("value.whitened").alias("whitened"), F.col("value.explained").alias("explained"), "identity_error",
    )


def _codes_sql(rounds: int = codes.ROUNDS, width: int = 8) -> str:
    """Lloyd rounds unrolled; ``width`` entries a part."""
    cells = range(1, width + 1)
    square = " + ".join(f"(p.c{j} - b.c{j}) * (p.c{j} - b.c{j})" for j in cells)

    def mean(j: int) -> str:  # floor of the quotient of whole numbers
        return f"(sum(c{j}) - (((sum(c{j}) % count(*)) + count(*)) % count(*))) // count(*)"

    def assigned(step: int) -> str:
        return f"""a{step} AS MATERIALIZED (
  SELECT p.*, entry, distance FROM p JOIN (
    SELECT r, position, min(({square}) * {codes.ENTRIES} + entry) % {codes.ENTRIES} AS entry,
      min(({square}) * {codes.ENTRIES} + entry) // {codes.ENTRIES} AS distance
    FROM p JOIN b{step} b USING (position) GROUP BY r, position) n USING (r, position)
)"""

    def updated(step: int) -> str:
        return f"""b{step} AS MATERIALIZED (
  SELECT b.position, b.entry, {", ".join(f"CAST(coalesce(m.c{j}, b.c{j}) AS BIGINT) AS c{j}" for j in cells)}
  FROM b{step - 1} b LEFT JOIN (
    SELECT position, entry, {", ".join(f"{mean(j)} AS c{j}" for j in cells)} FROM a{step - 1} GROUP BY position, entry
  ) m ON m.position = b.position AND m.entry = b.entry
)"""

    steps = ",\n".join(f"{assigned(k)},\n{updated(k + 1)}" for k in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER () AS r,
    list_transform(embedding, lambda c: CAST(floor({codes.SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), p AS MATERIALIZED (
  SELECT r, position, {", ".join(f"x[position * {width} + {j}] AS c{j}" for j in cells)}
  FROM kept, (SELECT unnest(generate_series(0, {codes.PARTS - 1})) AS position) t
), b0 AS MATERIALIZED (
  SELECT position, entry, {", ".join(f"c{j}" for j in cells)}
  FROM p JOIN (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {codes.ENTRIES}) s USING (r)
), {steps}, {assigned(rounds)}, book AS (
  SELECT sha256(string_agg(concat_ws(',', {", ".join(f"c{j}" for j in cells)}), ',' ORDER BY position, entry)) AS codebooks_sha256 FROM b{rounds}
), coded AS (
  SELECT r, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY position) AS code, CAST(sum(distance) AS BIGINT) AS error FROM a{rounds} GROUP BY r
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (r), book
"""


@query("op12_product_codes", _codes_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, book = codes.compress(read(spark, sf_dir, "embeddings"))
    found = codes.group_errors(checkpoint_cut(coded))
    digits = F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0"))
    return found.select(
        "vec_id", F.array_join(digits, "").alias("code"), "error", "label_error", F.lit(codes.digest(book)).alias("codebooks_sha256")
    )


@query("op13_toxicity")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, toxicity.learnable(labels))
    return toxicity.score(docs, model).withColumn("held_out", toxicity.held_out("doc_id")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
