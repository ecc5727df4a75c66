"""One query per training-data operator on the driver's tables, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plotwise.llm import exact_dedup, line_dedup, merkle, minhash, mixing, packing, pii, quality, search, secrets, sharding, simhash, warc
from plotwise.llm.common import documents

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


@query("op1_line_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(documents(spark, sf_dir), growing=True)


@query(
    "op2_minhash_near_dedup",
    r"""
    WITH RECURSIVE d AS (
      SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
      FROM documents
    ), g AS (
      SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0
    ), s AS (
      SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END, ' ') AS shingle FROM g
    ), n AS (
      SELECT doc_id, count(*) AS n FROM s GROUP BY 1
    ), p AS (
      SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m
      FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
    ), l AS (
      SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)
    ), e AS (
      SELECT a, b FROM l UNION SELECT b, a FROM l
    ), r(doc_id, root) AS (
      SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id
    ), c AS (
      SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1
    )
    SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept
    FROM c LEFT JOIN n ON n.doc_id = c.doc_id
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


@query("op3_pii")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(documents(spark, sf_dir))


@query(
    "op4_warc_normalise",
    """
    WITH p AS (
      SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) || '00' AS hex,
             min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
      FROM pages
    )
    SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
           array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             1 + ((('0x' || substr(hex, (i * 5 // 4 + 1)::INTEGER, 3))::INTEGER >> (7 - i * 5 % 4)::INTEGER) & 31), 1)), '') AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
    FROM p
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_secret_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(documents(spark, sf_dir))


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


@query(
    "op7_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


@query(
    "op8_source_mixing",
    r"""
    WITH d AS (
      SELECT doc_id, source, coalesce(text, '') AS body,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
      FROM documents
    ), s AS (
      SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
      FROM d GROUP BY source
    ), o AS (
      SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS place,
             (sum(source_size) OVER ())::BIGINT AS total
      FROM s
    ), c AS (
      SELECT *, (total - coalesce(sum(3 * source_size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
             (sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS open
      FROM o
    ), f AS (
      SELECT *, 3 * source_size * open < weight * rest AS capped FROM c
    ), t AS (
      SELECT source, source_size,
             CASE WHEN capped THEN 3.0::DOUBLE * source_size
                  ELSE coalesce((SELECT min_by(rest / open, place) FROM f WHERE NOT capped), 0) * weight END AS target
      FROM f
    ), k AS (
      SELECT d.doc_id, d.size, t.source_size, t.target, d.source,
             -ln((('0x' || substr(md5('23:' || coalesce(d.doc_id::VARCHAR, '-' || md5(d.body))), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
             / CASE WHEN d.size > 0 THEN greatest(0.5::DOUBLE, 1.0::DOUBLE - (length(d.body) - length(translate(d.body, '#*$%&|<>!', ''))) / d.size) ELSE 0.5 END AS key
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
    ), p AS (
      SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs
      FROM k
    )
    SELECT doc_id, size, source_size, target,
           (epochs * size + greatest(0, least(size, round(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken
    FROM p
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir), keep=["doc_id"])


@query("op9_quality_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op10_sharding")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleaved_shards(documents(spark, sf_dir))


@query(
    "op11_merkle_manifest",
    """
    WITH RECURSIVE f AS (
      SELECT *, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS grp,
             coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
             coalesce(strlen(text) || ':' || text, '-') AS tail
      FROM documents
    ), crc AS (
      SELECT doc_id, doc_id::VARCHAR AS s, 0 AS k, 4294967295 AS c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
      UNION ALL
      SELECT doc_id, s, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END
      FROM (SELECT doc_id, s, k, CASE WHEN k % 8 = 0 THEN xor(c, ascii(substr(s, k // 8 + 1, 1))::BIGINT) ELSE c END AS x FROM crc WHERE k < 8 * length(s))
    ), t AS (
      SELECT doc_id FROM crc WHERE k = 8 * length(s) AND xor(c, 4294967295) % 7 = 0
    ), h AS (
      SELECT grp, doc_id, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
             sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) AS other
      FROM f
    ), leaves AS (
      SELECT grp, doc_id, leaf, CASE WHEN doc_id IN (SELECT doc_id FROM t) THEN other ELSE leaf END AS now,
             row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n
      FROM h
    ), lv AS (
      SELECT grp, 0 AS level, idx, n, leaf AS h FROM leaves
      UNION ALL
      SELECT grp, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM lv WHERE n > 1 GROUP BY grp, level, n, idx // 2
    ), tops AS (
      SELECT grp, h, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM lv WHERE n = 1
    ), up AS (
      SELECT 0 AS level, idx, n, h FROM tops
      UNION ALL
      SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY level, n, idx // 2
    ), climb AS (
      SELECT grp, doc_id, leaf, 0 AS level, idx, n, '' AS proof, now AS h FROM leaves
      UNION ALL
      SELECT c.grp, c.doc_id, c.leaf, c.level + 1, c.idx // 2, (c.n + 1) // 2, c.proof || coalesce(s.h, ''),
             sha256(CASE WHEN c.idx % 2 = 1 THEN s.h || c.h ELSE c.h || coalesce(s.h, '') END)
      FROM climb c LEFT JOIN lv s ON s.grp = c.grp AND s.level = c.level AND s.idx = xor(c.idx, 1) WHERE c.n > 1
    ), rest AS (
      SELECT doc_id, leaf, t.h AS subroot, 0 AS level, t.idx, t.n, c.proof, c.h FROM climb c JOIN tops t ON c.grp = t.grp WHERE c.n = 1
      UNION ALL
      SELECT c.doc_id, c.leaf, c.subroot, c.level + 1, c.idx // 2, (c.n + 1) // 2, c.proof || coalesce(s.h, ''),
             sha256(CASE WHEN c.idx % 2 = 1 THEN s.h || c.h ELSE c.h || coalesce(s.h, '') END)
      FROM rest c LEFT JOIN up s ON s.level = c.level AND s.idx = xor(c.idx, 1) WHERE c.n > 1
    )
    SELECT doc_id, leaf, subroot, u.h AS root, sha256(proof) AS proof_sha256, r.h AS folded_root, r.h = u.h AS verified
    FROM rest r, (SELECT h FROM up WHERE n = 1) u WHERE r.n = 1
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir))


@query("op12_simhash_near_dedup")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_classes(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


@query(
    "op13_ranked_search",
    r"""
    WITH d AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
      FROM documents
    ), q AS (
      SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM benchmark
    ), s AS (
      SELECT count(*) FILTER (len(t) > 0) AS big_n, sum(len(t))::BIGINT AS big_l FROM d
    ), o AS (
      SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d
    ), p AS (
      SELECT doc_id, n, term, count(*) AS tf FROM o WHERE term IN (SELECT term FROM q) GROUP BY ALL
    ), w AS (
      SELECT term, floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, big_n
    ), c AS (
      SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * big_n) // big_l)))))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY 1, 2
    ), r AS (
      SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score FROM c WHERE score > 0
    )
    SELECT * FROM r WHERE rank <= 50
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
