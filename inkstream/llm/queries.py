"""The opN queries and their SQL: thin calls of the operators with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chaining, compression, interpolation, licenses, merkle, minhash, packing, perplexity, runs, sharding, tokens, warc, winnowing

CONTEXT = 1024


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The path of a public tokenizer's file; installed alike on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = perplexity.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity", "lower", "upper")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(), CONTEXT)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "round", "part", "part_bins", "part_bound")


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = winnowing.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), vocabulary(), CONTEXT)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.repeated_passages(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_words", "n_matched", "source_doc_id", "source_start")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(table(spark, sf_dir, "documents"), 24)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("tk")


def op11_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    out = interpolation.scores(table(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.checked(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.runs_of_documents(table(spark, sf_dir, "documents"), runs.planted))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _crc(text: str) -> str:
    """SQL for the unsigned crc32 of a string of ASCII characters: shifts by bits over its code points."""
    bits = "list_reduce(range(8), lambda r, k: CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(c, b))"
    return f"xor(list_reduce([CAST(ord(x) AS BIGINT) FOR x IN string_split({text}, '')], lambda c, b: {bits}, 4294967295), 4294967295)"


_SIZED = "CASE WHEN {0} IS NULL THEN '-' ELSE concat(strlen(CAST({0} AS VARCHAR)), ':', {0}) END"
_LEAF = "sha256(concat(" + ", ".join(_SIZED.format(x) for x in ("doc_id", "source", "lang", "n_chars")) + ", " + _SIZED + "))"

ORACLE_SQL = {
    "op5_winnowing": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS g
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, s, n FROM dw JOIN iw USING (n, g)),
p AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS keeper FROM p WHERE strlen(html) >= 1000 GROUP BY html)
SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN keeper IS NOT NULL AND keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN g USING (html)""",
    "op10_minhash": """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT l.b, r.root FROM r JOIN l ON r.doc_id = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.root AS component_id, d.doc_id = c.root AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) c USING (doc_id)""",
    "op12_merkle": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_LEAF.format("text")} AS leaf,
         CASE WHEN {_crc("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_LEAF.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_LEAF.format("text")} END AS changed FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
up AS (SELECT tree, 0 AS lvl, pos, n, leaf AS h FROM l
       UNION ALL SELECT tree, lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY tree, lvl, pos // 8, n),
subs AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
rup AS (SELECT 0 AS lvl, pos, n, subroot AS h FROM subs
        UNION ALL SELECT lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM rup WHERE n > 1 GROUP BY lvl, pos // 8, n),
root AS (SELECT h AS root FROM rup WHERE n = 1),
side AS (SELECT a.tree, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
         FROM up a JOIN up b ON a.tree = b.tree AND a.lvl = b.lvl AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY ALL),
rside AS (SELECT a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
          FROM rup a JOIN rup b ON a.lvl = b.lvl AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY ALL),
depth AS (SELECT tree, max(lvl) AS deep FROM up GROUP BY tree),
steps AS (SELECT tree, lvl, pos, l, r FROM side
          UNION ALL SELECT s.tree, deep + x.lvl, s.pos // CAST(8 ** x.lvl AS BIGINT), x.l, x.r FROM subs s JOIN depth USING (tree) JOIN rside x ON x.pos = s.pos // CAST(8 ** x.lvl AS BIGINT)),
walk AS (SELECT l.tree, l.pos AS leaf_pos, 0 AS lvl, l.changed AS h, '' AS proof FROM l
         UNION ALL SELECT w.tree, w.leaf_pos, w.lvl + 1, sha256(s.l || w.h || s.r), w.proof || s.l || s.r
         FROM walk w JOIN depth USING (tree) JOIN subs t USING (tree) JOIN steps s ON s.tree = w.tree AND s.lvl = w.lvl
          AND s.pos = CASE WHEN w.lvl < deep THEN w.leaf_pos // CAST(8 ** w.lvl AS BIGINT) ELSE t.pos // CAST(8 ** (w.lvl - deep) AS BIGINT) END),
last AS (SELECT tree, leaf_pos, arg_max(h, lvl) AS folded_root, arg_max(proof, lvl) AS proof FROM walk GROUP BY ALL)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN last ON l.tree = last.tree AND l.pos = last.leaf_pos JOIN subs ON subs.tree = l.tree, root""",
    "op13_periodic_runs": f"""
WITH d AS (SELECT doc_id, {_crc("CAST(doc_id AS VARCHAR)")} AS h, regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+') AS w FROM documents),
a AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a FROM d),
t AS (SELECT doc_id, n, CASE WHEN a = n THEN w ELSE [w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END + 1] FOR i IN range(n)] END AS w FROM a),
x AS (SELECT doc_id, n, unnest(w) AS v, unnest(range(n)) AS i FROM t),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS p FROM x JOIN x y ON x.doc_id = y.doc_id AND x.v = y.v AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS k FROM m) GROUP BY doc_id, p, k HAVING count(*) >= greatest(12 - p, p)),
r AS (SELECT doc_id, start, length, min(p) AS period FROM s GROUP BY ALL),
g AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines,
             first(struct_pack(start, length, period) ORDER BY length DESC, start, period) AS b FROM r GROUP BY doc_id),
o AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
c AS (SELECT x.doc_id, string_agg(v, ' ' ORDER BY i) AS kept FROM x ANTI JOIN o USING (doc_id, i) GROUP BY x.doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, b.start AS start, b.length AS length, b.period AS period, b.length * 1000 // b.period AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN g USING (doc_id) LEFT JOIN c USING (doc_id)""",
}
