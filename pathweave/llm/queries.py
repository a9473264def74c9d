"""Registered queries of this package: one ``opN_<name>`` per operator, over whole tables.

Each applies its operator with production parameters and returns its full
result; ``ORACLES`` holds DuckDB SQL where SQL can say the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SQL_WORDS = r"coalesce(regexp_extract_all({}, '[^\x20\x09-\x0D]+'), [])"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def _query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return deco


@_query("op1_substring_dedup", f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS.format('text')} AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d),
win AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS s FROM places),
earliest AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
marked AS (SELECT win.doc_id, win.p FROM win JOIN earliest USING (s) WHERE win.doc_id > m),
gone AS (SELECT DISTINCT doc_id, p + k AS q FROM (SELECT doc_id, p, unnest(range(0, 50)) AS k FROM marked)),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.q) AS t FROM each e
         ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.q = g.q GROUP BY e.doc_id),
n AS (SELECT doc_id, count(*) AS c FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(c, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)""")
def op1(spark, sf_dir):
    from .substring_dedup import substring_dedup
    return substring_dedup(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@_query("op7_near_duplicates", f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SQL_WORDS.format(_LOWER.format('text'))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[p:p + 4], ' ')) AS h
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.c + nb.c - i)),
reach AS (SELECT a AS doc_id, a AS r FROM link UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r),
comp AS (SELECT doc_id, min(r) AS component FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(c, 0)::BIGINT AS n_shingles, coalesce(component, d.doc_id) AS component_id,
       coalesce(component, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)""")
def op7(spark, sf_dir):
    from .minhash import near_duplicates
    return near_duplicates(_read(spark, sf_dir, "documents"))


@_query("op5_benchmark_decontamination", f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS.format(_LOWER.format('text'))} AS w FROM documents),
i AS (SELECT item_id, {_SQL_WORDS.format(_LOWER.format('text'))} AS w FROM benchmark),
ds AS (SELECT doc_id, p - 1 AS p, md5(array_to_string(w[p:p + 4], ' ')) AS h
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM d WHERE len(w) > 0)),
its AS (SELECT item_id, greatest(len(w) - 4, 1) AS m, md5(array_to_string(w[p:p + 4], ' ')) AS h
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM i WHERE len(w) > 0)),
ic AS (SELECT item_id, any_value(m) AS m, h, count(*) AS c FROM its GROUP BY item_id, h),
hit AS (SELECT doc_id, item_id, m, ds.h, p, c FROM ds JOIN ic USING (h)),
win AS (SELECT doc_id, item_id, m, h, c, unnest(range(p - m + 1, p + 1)) AS s FROM hit),
wc AS (SELECT doc_id, item_id, m, s, h, least(count(*), any_value(c)) AS b FROM win GROUP BY ALL),
wi AS (SELECT doc_id, item_id, m, s, sum(b) AS b FROM (SELECT doc_id, item_id, m, s, h, b FROM wc) GROUP BY ALL),
dn AS (SELECT doc_id, count(*) AS n FROM ds GROUP BY doc_id),
sim AS (SELECT doc_id, item_id, greatest(s, 0) AS s, b,
               (least(s + m, n) - greatest(s, 0)) + m - b AS e FROM wi JOIN dn USING (doc_id)),
ok AS (SELECT doc_id, item_id, s, b / e AS similarity FROM sim WHERE 100 * b >= 75 * e)
SELECT doc_id, item_id, max(similarity)::DOUBLE AS similarity,
       min(s) FILTER (similarity = top)::BIGINT AS window_start
FROM (SELECT *, max(similarity) OVER (PARTITION BY doc_id, item_id) AS top FROM ok) GROUP BY doc_id, item_id""")
def op5(spark, sf_dir):
    from .decontamination import contaminated
    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


@_query("op2_lexical_packing")
def op2(spark, sf_dir):
    import public_tokenizers

    from .packing import pack
    return pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query("op3_arc_to_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
q AS (SELECT page_id, strlen(t)::BIGINT AS payload_bytes, sha256(t) AS payload_digest, min(page_id) OVER (PARTITION BY t) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM q""")
def op3(spark, sf_dir):
    from .warc import arc_round_trip
    return arc_round_trip(_read(spark, sf_dir, "pages"))


@_query("op4_suffix_tree_scores")
def op4(spark, sf_dir):
    from .suffix_tree import suffix_tree_scores
    return suffix_tree_scores(_read(spark, sf_dir, "documents"))


@_query("op6_histogram_shards")
def op6(spark, sf_dir):
    from .sharding import histogram_shards
    return histogram_shards(_read(spark, sf_dir, "documents"))


@_query("op8_quality_scores")
def op8(spark, sf_dir):
    from .boosting import quality_scores
    return quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


@_query("op9_language_mixture")
def op9(spark, sf_dir):
    from .language_mixture import predict_languages
    return predict_languages(_read(spark, sf_dir, "documents")).drop("languages")


@_query("op10_weak_quality_rules")
def op10(spark, sf_dir):
    from .weak_rules import weak_quality
    return (weak_quality(_read(spark, sf_dir, "documents"))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"))


@_query("op11_line_dedup", f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS p FROM d),
k AS (SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.p, k.line, coalesce(k.doc_id < r.last, false) AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""")
def op11(spark, sf_dir):
    from .line_dedup import line_keep_bitmaps
    out = line_keep_bitmaps(_read(spark, sf_dir, "documents"), with_text=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@_query("op12_importance_resampling")
def op12(spark, sf_dir):
    from .importance import importance_resample
    out = importance_resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


@_query("op13_embedding_whitening")
def op13(spark, sf_dir):
    from .whitening import whiten_embeddings
    out = whiten_embeddings(_read(spark, sf_dir, "embeddings"))
    each = out.select("vec_id", "n", "deviation", "identity_error", F.inline(F.expr(
        "transform(whitened, (w, i) -> named_struct('component', i + 1, 'whitened', w, 'explained', explained[i]))")))
    return each.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
