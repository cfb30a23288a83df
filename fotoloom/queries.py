"""The engine's registered queries, each over whole tables, with SQL for most."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import FrameConfig, SimilarityConfig, TransferConfig
from .functions import bits, metadata, paths, phash, similarity
from .operators import candidates, cluster, components, dispatch, frames, memo, select
from .plans import report, template, transfer
from .plans.pipeline import Media
from .plans.views import DISTANCE_SQL, M_FILES_SQL, M_FRAMES_SQL, M_NEAR_SQL, SCORE_SQL, m_files, m_frames, m_hash, m_near, table
from .sources import catalog, discovery
from .staging import stage

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


# --- paths and formats -------------------------------------------------------------------

EXT_SQL = "regexp_extract({0}, '[^/][.]([^./]*)$', 1)"
TYPE_SQL = f"CASE WHEN lower({EXT_SQL}) IN ({_list(paths.IMAGE_EXTENSIONS)}) THEN 1 WHEN lower({EXT_SQL}) IN ({_list(paths.VIDEO_EXTENSIONS)}) THEN 0 END"
FILE_TYPE_SQL = TYPE_SQL.replace("{0}", "file_path")
FILE_EXT_SQL = EXT_SQL.format("file_path")


@query(f"WITH {M_FILES_SQL} SELECT file_path, lower({FILE_EXT_SQL}) AS ext, ({FILE_TYPE_SQL})::INTEGER AS type FROM m_files WHERE ({FILE_TYPE_SQL}) IS NOT NULL")
def discover_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.supported(m_files(spark, sf_dir).select("file_path")).select("file_path", "ext", "type")


@query(
    f"""WITH {M_FILES_SQL}, s AS (SELECT *, lower({FILE_EXT_SQL}) AS ext, ({FILE_TYPE_SQL})::INTEGER AS type FROM m_files),
per AS (SELECT type, ext, count(*) AS n, count(error) AS n_errors FROM s WHERE type IS NOT NULL GROUP BY type, ext)
SELECT * FROM per UNION ALL SELECT NULL, NULL, coalesce(sum(n), 0)::BIGINT, coalesce(sum(n_errors), 0)::BIGINT FROM per"""
)
def format_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.format_stats(discovery.supported(m_files(spark, sf_dir).select("file_path", "error")))


@query(
    """WITH b AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS p FROM pages), n AS (SELECT *, regexp_extract(p, '([^/]*)$', 1) AS base FROM b)
SELECT page_id, base, regexp_extract(p, '[^/][.]([^./]*)$', 1) AS ext,
       CASE WHEN regexp_extract(base, '^(.+)[.][^.]*$', 1) = '' THEN base ELSE regexp_extract(base, '^(.+)[.][^.]*$', 1) END AS stem,
       CASE WHEN regexp_extract(p, '^(.*)/[^/]*$', 1) <> '' THEN regexp_extract(p, '^(.*)/[^/]*$', 1) WHEN p LIKE '/%' THEN '/' ELSE '.' END AS dir
FROM n"""
)
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("p"))
    c = F.col("p")
    return p.select("page_id", paths.basename(c).alias("base"), paths.extension(c).alias("ext"), paths.stem(c).alias("stem"), paths.dirname(c).alias("dir"))


# --- content hashes, metadata, scores ------------------------------------------------------


@query(
    f"""WITH {M_FILES_SQL}, x AS (SELECT doc_id, size, hex(encode(text)) AS h FROM m_files)
SELECT doc_id, size, md5(CASE WHEN size > 1000 THEN unhex(h[1:1000] || h[len(h) - 999:]) ELSE unhex(h) END) AS content_hash FROM x"""
)
def partial_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m_files(spark, sf_dir).select("doc_id", "size", metadata.partial_md5(F.col("content"), 1000).alias("content_hash"))


@query("SELECT md5(text) AS content_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def content_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.groupBy(F.md5("text").alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


TAGS_SQL = """tags AS (
  SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN 'unknown' ELSE strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') END AS taken,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') END AS made,
         CASE WHEN o_orderkey % 3 = 0 THEN '0' WHEN o_orderkey % 3 = 1 THEN NULL ELSE (o_orderkey % 4000)::VARCHAR END AS w, (o_custkey % 3000)::VARCHAR AS ew,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_custkey % 90)::VARCHAR || '.5' END AS lat, c_mktsegment AS model
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k, c, d = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
    taken = F.when(k % 7 == 0, None).when(k % 7 == 1, "unknown").otherwise(F.date_format(d, "yyyy:MM:dd HH:mm:ss"))
    made = F.when(k % 5 == 0, None).otherwise(F.date_format(d + F.expr("INTERVAL 1 DAY"), "yyyy-MM-dd HH:mm:ss"))
    width = F.when(k % 3 == 0, "0").when(k % 3 == 1, None).otherwise((k % 4000).cast("string"))
    lat = F.when(k % 11 == 0, None).otherwise(F.concat((c % 90).cast("string"), F.lit(".5")))
    pairs = [("DateTimeOriginal", taken), ("CreateDate", made), ("ImageWidth", width), ("ExifImageWidth", (c % 3000).cast("string")), ("GPSLatitude", lat), ("GPSLongitude", lat), ("Model", F.col("c_mktsegment"))]
    absent = [(t, F.lit(None).cast("string")) for t in ("MediaCreateDate", "ImageHeight", "ExifImageHeight")]
    return o.select(k.alias("k"), F.create_map(*[x for name, v in pairs + absent for x in (F.lit(name), v)]).alias("tags"))


@query(
    f"""WITH {TAGS_SQL} SELECT k, coalesce(nullif(TRY_CAST(w AS INTEGER), 0), nullif(TRY_CAST(ew AS INTEGER), 0), 0)::INTEGER AS width, 0::INTEGER AS height, TRY_CAST(lat AS DOUBLE) AS gps_latitude,
TRY_CAST(lat AS DOUBLE) AS gps_longitude, model AS camera_model,
coalesce(TRY_CAST(regexp_replace(taken, '(\\d{{4}}):(\\d{{2}}):(\\d{{2}})', '\\1-\\2-\\3') AS TIMESTAMP), TRY_CAST(made AS TIMESTAMP)) AS image_date FROM tags"""
)
def exif_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tags(spark, sf_dir).select("k", metadata.exif_metadata(F.col("tags")).alias("m")).select("k", "m.*")


@query(f"WITH {M_NEAR_SQL} SELECT file_path, round({SCORE_SQL}, 6) AS score FROM m_near")
def entry_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m_near(spark, sf_dir).select("file_path", F.round(metadata.score(), 6).alias("score"))


# --- perceptual hashes -----------------------------------------------------------------------


@query(f"WITH {M_NEAR_SQL} SELECT file_path, phash FROM m_near")
def phash_from_dct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m_near(spark, sf_dir).select("file_path", "phash")


@query("SELECT vec_id, list_sort(list_transform(embedding, lambda x: x::DOUBLE))[len(embedding) // 2 + 1] AS kth FROM embeddings WHERE embedding IS NOT NULL")
def median_kth(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    return e.select("vec_id", phash.kth_smallest(F.transform("embedding", lambda x: x.cast("double")), F.floor(F.size("embedding") / 2).cast("int")).alias("kth"))


def _rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where("size(embedding) = 64")
    return e.select("vec_id", F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x.cast("double") * 300 + 128)))).alias("gray"))


@query(
    """WITH r AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(0, least(255, floor(x::DOUBLE * 300 + 128)))::DOUBLE) AS g FROM embeddings WHERE len(embedding) = 64),
u AS (SELECT vec_id, unnest(range(0, 64)) AS i, g FROM r), c AS (
  SELECT vec_id, i, list_sum(list_transform(range(0, 64), lambda p: g[p + 1] * cos((2 * (p // 8) + 1) * (i // 8) * pi() / 16) * cos((2 * (p % 8) + 1) * (i % 8) * pi() / 16)))
         * 0.25 * CASE WHEN i // 8 = 0 THEN sqrt(0.5) ELSE 1 END * CASE WHEN i % 8 = 0 THEN sqrt(0.5) ELSE 1 END AS x FROM u)
SELECT vec_id, i::INTEGER AS i, round(x, 4) + 0.0 AS coefficient FROM c"""
)
def dct_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = _rasters(spark, sf_dir).select("vec_id", phash.dct_udf(8)(F.transform("gray", lambda x: x.cast("double"))).alias("d"))
    return block.select("vec_id", F.posexplode("d").alias("i", "x")).select("vec_id", "i", (F.round("x", 4) + F.lit(0.0)).alias("coefficient"))


@query(f"WITH {M_NEAR_SQL} SELECT file_path, phash[1:4] AS k1, phash[5:8] AS k2, phash[9:12] AS k3, phash[13:16] AS k4 FROM m_near")
def lsh_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = phash.lsh_keys(F.col("phash"))
    return m_near(spark, sf_dir).select("file_path", *[keys[i].alias(f"k{i + 1}") for i in range(4)])


# --- neighbours ----------------------------------------------------------------------------


def _query_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of the searches: originals whose id divides by 20."""
    h = m_hash(spark, sf_dir).where("vec_id % 20 = 0")
    return h.select(F.concat(F.lit("q/"), F.col("vec_id").cast("string")).alias("file_path"), F.conv(F.array_join(F.transform("bytes", lambda b: F.lpad(F.hex(b), 2, "0")), ""), 16, -10).cast("long").alias("bits"))


@query(
    f"""WITH {M_NEAR_SQL}, q AS (SELECT DISTINCT regexp_extract(file_path, 'IMG_([0-9]+)', 1)::BIGINT AS v, b1, b2, b3, b4 FROM m_near WHERE file_path LIKE 'v/%')
SELECT 'q/' || p.v AS query_id, q.file_path, ({DISTANCE_SQL})::INTEGER AS distance FROM q AS p JOIN m_near AS q ON {DISTANCE_SQL} <= 12 WHERE p.v % 20 = 0"""
)
def range_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.range_search(_query_rows(spark, sf_dir), m_near(spark, sf_dir), 12)


@query(
    f"""WITH {M_NEAR_SQL}, q AS (SELECT regexp_extract(file_path, 'IMG_([0-9]+)', 1)::BIGINT AS v, b1, b2, b3, b4 FROM m_near WHERE file_path LIKE 'v/%'),
d AS (SELECT 'q/' || p.v AS query_id, q.file_path, ({DISTANCE_SQL})::INTEGER AS distance FROM q AS p, m_near AS q WHERE p.v % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, file_path, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, file_path) AS rank FROM d) WHERE rank <= 5"""
)
def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.knn(_query_rows(spark, sf_dir), m_near(spark, sf_dir), 5)


@query(f"WITH {M_NEAR_SQL}, u AS (SELECT DISTINCT phash, b1, b2, b3, b4 FROM m_near) SELECT p.phash AS p, q.phash AS q, ({DISTANCE_SQL})::INTEGER AS distance FROM u p JOIN u q ON p.phash < q.phash AND {DISTANCE_SQL} <= 8")
def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = candidates.near_hash_pairs(m_near(spark, sf_dir), 8)
    as_hex = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    p, q = as_hex(F.col("p")), as_hex(F.col("q"))
    return pairs.select(F.least(p, q).alias("p"), F.greatest(p, q).alias("q"), "distance")


KEYS_SQL = "(p.b1 IN (q.b1, q.b2, q.b3, q.b4) OR p.b2 IN (q.b1, q.b2, q.b3, q.b4) OR p.b3 IN (q.b1, q.b2, q.b3, q.b4) OR p.b4 IN (q.b1, q.b2, q.b3, q.b4))"


@query(f"WITH {M_NEAR_SQL} SELECT p.file_path AS a, q.file_path AS b FROM m_near p JOIN m_near q ON p.file_path <> q.file_path AND {KEYS_SQL}")
def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.lsh_candidates(m_near(spark, sf_dir))


BOUND_SQL = "CASE WHEN p.is_video OR q.is_video THEN 4 ELSE 0 END"
PAIRS_SQL = f"pairs AS (SELECT p.file_path AS a, q.file_path AS b, ({DISTANCE_SQL})::INTEGER AS distance FROM m_near p JOIN m_near q ON p.file_path < q.file_path AND {KEYS_SQL} AND {DISTANCE_SQL} <= {BOUND_SQL})"


@query(f"WITH {M_NEAR_SQL}, {PAIRS_SQL} SELECT * FROM pairs")
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.similar_pairs(m_near(spark, sf_dir), SimilarityConfig())


@query(f"WITH {M_NEAR_SQL}, f AS (SELECT *, phash[1] = '0' AS bad FROM m_near) SELECT p.file_path AS query_id, q.file_path, ({DISTANCE_SQL})::INTEGER AS distance FROM f p JOIN f q ON p.file_path <> q.file_path AND NOT p.bad AND NOT q.bad AND {DISTANCE_SQL} <= {BOUND_SQL}")
def valid_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg, f = SimilarityConfig(), m_near(spark, sf_dir)
    bounds = [F.lit(cfg.max_distance(t)).alias(n) for n, t in (("bound_image", cfg.image), ("bound_mixed", cfg.image_video), ("bound_video", cfg.video))]
    found = candidates.range_search(f.select("file_path", "bits"), f.select("file_path", "bits"), 4)
    return candidates.valid_neighbors(found, f.select("file_path", "is_video", *bounds), f.where("phash LIKE '0%'"))


@query(f"WITH {M_NEAR_SQL}, u AS (SELECT DISTINCT phash, b1, b2, b3, b4 FROM m_near) SELECT ({DISTANCE_SQL})::INTEGER AS distance, count(*) AS n_pairs, count_if({KEYS_SQL}) AS n_found FROM u p JOIN u q ON p.phash < q.phash AND {DISTANCE_SQL} <= 8 GROUP BY 1")
def lsh_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = candidates.near_hash_pairs(m_near(spark, sf_dir), 8)
    as_hex = lambda c: phash.lsh_keys(F.lower(F.lpad(F.hex(c), 16, "0")))
    return pairs.groupBy("distance").agg(F.count("*").alias("n_pairs"), F.count_if(F.arrays_overlap(as_hex(F.col("p")), as_hex(F.col("q")))).alias("n_found"))


# --- clusters and roles ----------------------------------------------------------------------


@query(f"WITH {M_NEAR_SQL} SELECT phash, count(*) AS n, min(file_path) AS first_path FROM m_near GROUP BY phash HAVING count(*) > 1")
def exact_phash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.exact_phash_groups(m_near(spark, sf_dir))


# files of equal hashes are one group whatever their types
SETS_SQL = f"""{PAIRS_SQL}, links AS (
  SELECT a, b FROM pairs UNION SELECT p.file_path, q.file_path FROM m_near p JOIN m_near q ON p.phash = q.phash AND p.file_path <> q.file_path
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(f, r) AS (SELECT DISTINCT a, a FROM edges UNION SELECT reach.f, edges.b FROM reach JOIN edges ON edges.a = reach.r),
sets AS (SELECT f AS file_path, min(r) AS set_id FROM reach GROUP BY f)"""


@query(f"WITH RECURSIVE {M_NEAR_SQL}, {SETS_SQL} SELECT * FROM sets")
def clusters_cc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.duplicate_sets(m_near(spark, sf_dir), SimilarityConfig())


@query(
    f"""WITH RECURSIVE {M_NEAR_SQL}, {PAIRS_SQL}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
around AS MATERIALIZED (SELECT a AS f, list(b ORDER BY b) AS n, row_number() OVER (ORDER BY a) AS i FROM e GROUP BY a),
g(i, taken, members) AS (
  SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[]
  UNION ALL
  SELECT i, CASE WHEN len(m) > 1 THEN list_concat(taken, m) ELSE taken END, CASE WHEN len(m) > 1 THEN m ELSE [] END
  FROM (SELECT x.i, taken, CASE WHEN list_contains(taken, f) THEN [] ELSE list_concat([f], list_filter(n, lambda y: NOT list_contains(taken, y))) END AS m FROM g JOIN around x ON x.i = g.i + 1)
)
SELECT members[1] AS set_id, unnest(members) AS file_path FROM g WHERE len(members) > 0"""
)
def clusters_greedy_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.star_sets(stage(m_near(spark, sf_dir), "files")[0], SimilarityConfig())


@query(
    f"""WITH RECURSIVE {M_NEAR_SQL}, {PAIRS_SQL}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
cores AS (SELECT a FROM e GROUP BY a HAVING count(*) + 1 >= 3), ce AS (SELECT a, b FROM e WHERE a IN (FROM cores) AND b IN (FROM cores)),
reach(f, r) AS (SELECT a, a FROM cores UNION SELECT reach.f, ce.b FROM reach JOIN ce ON ce.a = reach.r), own AS (SELECT f, min(r) AS cluster_id FROM reach GROUP BY f)
SELECT f AS file_path, cluster_id, true AS is_core FROM own
UNION ALL SELECT b, cluster_id, false FROM (SELECT b, min(a) AS a FROM e WHERE a IN (FROM cores) AND b NOT IN (FROM cores) GROUP BY b) x JOIN own ON own.f = x.a"""
)
def clusters_dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.density_clusters(stage(m_near(spark, sf_dir), "files")[0], SimilarityConfig(), 3)


@query(
    f"""WITH RECURSIVE {M_NEAR_SQL}, {PAIRS_SQL}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(f, r) AS (SELECT DISTINCT a, a FROM e UNION SELECT reach.f, e.b FROM reach JOIN e ON e.a = reach.r)
SELECT min(r) AS set_id, f AS member FROM reach GROUP BY f"""
)
def merge_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars around each file, which overlap, united."""
    pairs = stage(cluster.similar_pairs(m_near(spark, sf_dir), SimilarityConfig()), "pairs")[0]
    own = pairs.select(F.col("a").alias("set_id"), F.col("a").alias("member"))
    return components.merge_sets(own.union(pairs.select("a", "b")).distinct())


SCORED_SQL = f"scored AS (SELECT m.*, set_id, {SCORE_SQL} AS score FROM m_near m LEFT JOIN sets USING (file_path)), ranked AS (SELECT *, CASE WHEN set_id IS NOT NULL THEN row_number() OVER (PARTITION BY set_id ORDER BY round(score, 6) DESC, file_path) END AS rank FROM scored)"
ROLES_SQL = f"""{SCORED_SQL}, top_ AS (SELECT set_id, file_path AS bp, is_video AS bv, width::BIGINT * height AS bq, image_date IS NOT NULL AS bd FROM ranked WHERE rank = 1),
fit AS (SELECT r.*, row_number() OVER (PARTITION BY r.set_id, phash ORDER BY round(score, 6) DESC, file_path) AS n FROM ranked r JOIN top_ USING (set_id)
        WHERE bv AND NOT is_video AND file_path <> bp AND width::BIGINT * height >= bq AND (NOT bd OR image_date IS NOT NULL)),
roles AS (SELECT r.*, CASE WHEN r.set_id IS NULL THEN 'unique' WHEN r.rank = 1 OR f.n = 1 THEN 'representative' ELSE 'duplicate' END AS role
          FROM ranked r LEFT JOIN fit f ON r.file_path = f.file_path)"""


def _roles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cfg = SimilarityConfig()
    files = stage(m_near(spark, sf_dir), "files")[0]
    sets = stage(cluster.duplicate_sets(files, cfg), "sets")[0]
    return files, select.roles(files, sets, cfg)


@query(f"WITH RECURSIVE {M_NEAR_SQL}, {SETS_SQL}, {SCORED_SQL} SELECT set_id, file_path AS best, round(score, 6) AS best_score FROM ranked WHERE rank = 1")
def best_per_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = stage(m_near(spark, sf_dir), "files")[0]
    best = select.best_of_sets(select.scored(files).join(cluster.duplicate_sets(files, SimilarityConfig()), "file_path"))
    return best.withColumn("best_score", F.round("best_score", 6))


@query(f"WITH RECURSIVE {M_NEAR_SQL}, {SETS_SQL}, {ROLES_SQL} SELECT set_id, file_path FROM fit WHERE n = 1")
def video_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = stage(m_near(spark, sf_dir), "files")[0]
    return select.captures(select.scored(files).join(cluster.duplicate_sets(files, SimilarityConfig()), "file_path"), SimilarityConfig())


LENIENT_SQL = f"""{SETS_SQL.replace(BOUND_SQL, "CASE WHEN p.is_video OR q.is_video THEN 6 ELSE 3 END")}, {ROLES_SQL.split(", roles AS (")[0]},
one AS MATERIALIZED (SELECT set_id, list(struct_pack(f := file_path, b1 := b1, b2 := b2, b3 := b3, b4 := b4) ORDER BY round(score, 6) DESC, file_path) AS l FROM fit WHERE n = 1 GROUP BY set_id),
scan(set_id, i, chosen) AS (
  SELECT set_id, 1, l[1:1] FROM one
  UNION ALL
  SELECT s.set_id, s.i + 1, CASE WHEN len(list_filter(chosen, lambda p: {DISTANCE_SQL.replace("q.", "q_.")} <= 3)) = 0 THEN list_append(chosen, q_) ELSE chosen END
  FROM (SELECT scan.set_id, i, chosen, l[i + 1] AS q_, l FROM scan JOIN one USING (set_id)) s WHERE s.i < len(l)
)"""


@query(f"WITH RECURSIVE {M_NEAR_SQL}, {LENIENT_SQL} SELECT set_id, unnest(chosen).f AS file_path FROM scan JOIN one USING (set_id) WHERE i = len(l)")
def video_captures_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan with a threshold that admits differing bits."""
    cfg = SimilarityConfig(image=0.95, image_video=0.9, video=0.9)
    files = stage(m_near(spark, sf_dir), "files")[0]
    return select.captures(select.scored(files).join(cluster.duplicate_sets(files, cfg), "file_path"), cfg)


@query(f"WITH RECURSIVE {M_NEAR_SQL}, {SETS_SQL}, {ROLES_SQL} SELECT file_path, set_id, role, rank::INTEGER AS rank, round(score, 6) AS score FROM roles")
def dedup_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roles(spark, sf_dir)[1].withColumn("score", F.round("score", 6)).select("file_path", "set_id", "role", "rank", "score")


@query(
    f"""WITH RECURSIVE {M_NEAR_SQL}, {SETS_SQL}, {ROLES_SQL}
SELECT count(*) AS n_files, count_if(role = 'unique')::BIGINT AS n_unique, count(DISTINCT set_id) AS n_sets, count_if(role = 'representative')::BIGINT AS n_representatives,
count_if(role = 'duplicate')::BIGINT AS n_duplicates, 0::BIGINT AS n_errors FROM roles"""
)
def dedup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.summary(_roles(spark, sf_dir)[1])


# --- frames ------------------------------------------------------------------------------------


def _videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = m_frames(spark, sf_dir)
    return f.groupBy("file_path").agg(F.first("duration").alias("duration"), F.array_sort(F.collect_list(F.struct("ts", "scene", "hash"))).alias("frames"))


@query(
    f"""WITH {M_FRAMES_SQL}, images AS (SELECT vec_id, ('0x' || substr(md5('image' || vec_id), 1, 4))::BIGINT AS h FROM embeddings WHERE vec_id % 20 = 0)
SELECT vec_id AS image, file_path AS video, max(1 - bit_count(xor(h, hash)) / 16.0::DOUBLE) AS similarity FROM images JOIN m_frames ON bit_count(xor(h, hash)) <= 4 GROUP BY ALL"""
)
def image_video_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0")
    images = images.select(F.col("vec_id").alias("image"), F.conv(F.substring(F.md5(F.concat(F.lit("image"), F.col("vec_id").cast("string"))), 1, 4), 16, 10).cast("long").alias("hash"))
    return frames.image_video_best(images, _videos(spark, sf_dir).select(F.col("file_path").alias("video"), "frames"), 0.75, bits=16)


@query(f"WITH {M_FRAMES_SQL} SELECT file_path, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM m_frames WHERE hash IS NOT NULL AND ts BETWEEN duration / 4 AND duration / 2 GROUP BY file_path")
def frames_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _videos(spark, sf_dir).withColumn("seen", frames.frames_in_range(F.col("frames"), F.col("duration") / 4, F.col("duration") / 2)).where(F.size("seen") > 0)
    ts = F.transform("seen", lambda f: f["ts"])
    return v.select("file_path", F.size("seen").cast("long").alias("n"), F.array_min(ts).alias("first_ts"), F.array_max(ts).alias("last_ts"))


@query(
    f"""WITH {M_FRAMES_SQL}, w AS (SELECT file_path, any_value(duration) AS d FROM m_frames GROUP BY file_path), s AS (SELECT file_path, unnest(range(0, floor((d - d / 3) / 50)::BIGINT + 1)) * 50.0::DOUBLE AS start, d / 3 AS len FROM w)
SELECT s.file_path, s.start, count(*) AS n FROM s JOIN m_frames m ON s.file_path = m.file_path AND m.hash IS NOT NULL AND m.ts BETWEEN s.start AND s.start + s.len GROUP BY ALL"""
)
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _videos(spark, sf_dir).withColumn("start", F.explode(frames.windows(F.col("duration"), F.col("duration") / 3, 50.0)))
    n = F.size(frames.frames_in_range(F.col("frames"), F.col("start"), F.col("start") + F.col("duration") / 3)).cast("long")
    return v.select("file_path", "start", n.alias("n")).where("n > 0")


@query(
    """WITH RECURSIVE t AS (SELECT conv_id, list(('0x' || substr(md5(coalesce(text, '')), 1, 4))::BIGINT ORDER BY turn, role) AS h FROM conversations GROUP BY conv_id),
p AS (SELECT x.conv_id AS a, y.conv_id AS b, x.h AS ha, y.h AS hb FROM t x JOIN t y ON y.conv_id = x.conv_id + 1),
d(a, b, ha, hb, i, r) AS (
  SELECT a, b, ha, hb, 0, [0.0::DOUBLE] || list_transform(hb, lambda z: 'Infinity'::DOUBLE) FROM p
  UNION ALL
  SELECT a, b, ha, hb, i + 1, list_reduce([['Infinity'::DOUBLE]] || list_transform(range(1, len(hb) + 1), lambda j: [bit_count(xor(ha[i + 1], hb[j])) / 16.0::DOUBLE, r[j], r[j + 1]]),
         lambda c, e: c || [e[1] + least(e[2], e[3], c[-1])])
  FROM d WHERE i < len(ha)
)
SELECT a, b, round(greatest(0, 1 - r[-1] / greatest(len(ha), len(hb))), 9) AS similarity FROM d WHERE i = len(ha)"""
)
def dtw_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    code = F.conv(F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 4), 16, 10).cast("long")
    t = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", code.alias("h")))), lambda x: x["h"]).alias("h"))
    pairs = t.select(F.col("conv_id").alias("a"), F.col("h").alias("ha")).join(t.select(F.col("conv_id").alias("b"), F.col("h").alias("hb")), F.col("b") == F.col("a") + 1)
    return pairs.select("a", "b", F.round(similarity.dtw_similarity(F.col("ha"), F.col("hb"), 16), 9).alias("similarity"))


# windows that show the same frames are one; costs are whole numbers of bits, a missing hash costs all 16
VIDEO_SQL = f"""{M_FRAMES_SQL},
v AS MATERIALIZED (SELECT regexp_extract(file_path, '([0-9]+)', 1)::BIGINT AS u, file_path, any_value(duration) AS d, list(hash ORDER BY ts, scene, hash NULLS FIRST) AS h,
      list(ts ORDER BY ts, scene, hash) FILTER (hash IS NOT NULL) AS st, list(hash ORDER BY ts, scene, hash) FILTER (hash IS NOT NULL) AS sh FROM m_frames GROUP BY file_path),
p AS MATERIALIZED (SELECT a.file_path AS a, b.file_path AS b, least(a.d, b.d) AS short, greatest(a.d, b.d) AS long_, CASE WHEN b.d < a.d THEN b.h ELSE a.h END AS hs,
      CASE WHEN b.d < a.d THEN a.st ELSE b.st END AS lt, CASE WHEN b.d < a.d THEN a.sh ELSE b.sh END AS lh FROM v a JOIN v b ON b.u = a.u + 1),
w AS (SELECT DISTINCT a, b, len(list_filter(lt, lambda t: t < s)) AS lo, len(list_filter(lt, lambda t: t <= s + short)) AS hi
      FROM (SELECT *, unnest(range(0, floor(long_ - short)::BIGINT + 1))::DOUBLE AS s FROM p)),
d(a, b, lo, hi, i, r) AS (
  SELECT w.a, w.b, lo, hi, lo, list_concat([0::BIGINT], list_transform(hs, lambda z: 1000000::BIGINT)) FROM w JOIN p USING (a, b) WHERE hi > lo
  UNION ALL
  SELECT d.a, d.b, lo, hi, i + 1, list_reduce(list_transform(range(1, len(hs) + 1), lambda j: [coalesce(bit_count(xor(lh[i + 1], hs[j])), 16)::BIGINT, least(r[j], r[j + 1])]),
         lambda c, e: list_append(c, e[1] + least(e[2], c[-1])), [1000000::BIGINT])
  FROM d JOIN p USING (a, b) WHERE i < hi
), best AS (SELECT a, b, max(greatest(0, 1 - r[-1] / 16.0::DOUBLE / greatest(hi - lo, len(hs)))) AS similarity FROM d JOIN p USING (a, b) WHERE i = hi GROUP BY a, b)"""


@query(f"WITH RECURSIVE {VIDEO_SQL} SELECT a, b, round(coalesce(similarity, 0), 9) AS similarity FROM p LEFT JOIN best USING (a, b)")
def video_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each video against the next, by time warping over windows that slide by the default step of a second."""
    short = lambda n: F.transform("frames", lambda f: F.struct(f["ts"].alias("ts"), f["hash"].alias("hash"))).alias(n)
    user = F.regexp_extract("file_path", "([0-9]+)", 1).cast("long")
    v = _videos(spark, sf_dir)
    a = v.select(F.col("file_path").alias("a"), F.col("duration").alias("duration_a"), short("frames_a"), (user + 1).alias("u"))
    b = v.select(F.col("file_path").alias("b"), F.col("duration").alias("duration_b"), short("frames_b"), user.alias("u"))
    found = frames.video_similarity(a.join(b, "u").drop("u"), SimilarityConfig().step_size, bits=16)
    return found.withColumn("similarity", F.round("similarity", 9))


@query(
    f"""WITH RECURSIVE {M_FRAMES_SQL}, v AS MATERIALIZED (SELECT file_path, any_value(duration) AS d, list(struct_pack(t := ts, s := scene) ORDER BY ts, scene, hash) AS f FROM m_frames GROUP BY file_path),
k(file_path, i, last_, kept) AS (
  SELECT file_path, 1, f[1].t, [f[1].t] FROM v WHERE d > 0
  UNION ALL
  SELECT file_path, i + 1, CASE WHEN keep THEN t ELSE last_ END, CASE WHEN keep THEN list_append(kept, t) ELSE kept END
  FROM (SELECT k.file_path, i, last_, kept, f[i + 1].t AS t, (f[i + 1].s > 0.05 AND f[i + 1].t - last_ >= 1.0::DOUBLE / 0.05::DOUBLE) OR f[i + 1].t - last_ >= d / least(ceil(d * 0.05::DOUBLE), 5) AS keep
        FROM k JOIN v USING (file_path) WHERE i < len(f))
)
SELECT file_path, CASE WHEN d > 0 THEN kept ELSE [] END AS kept FROM v LEFT JOIN (SELECT k.* FROM k JOIN v USING (file_path) WHERE i = len(f)) USING (file_path)"""
)
def frame_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = FrameConfig(target_fps=0.05)
    return _videos(spark, sf_dir).select("file_path", F.transform(frames.kept_frames(F.col("frames"), F.col("duration"), cfg), lambda f: f["ts"]).alias("kept"))


@query(
    f"""WITH {M_FRAMES_SQL}, v AS (SELECT file_path, any_value(duration) AS d, list(ts ORDER BY ts, scene) AS t FROM m_frames GROUP BY file_path), k AS (SELECT *, ceil(d * 0.01) AS target, greatest(ceil(d * 0.01), 20)::INTEGER AS k FROM v)
SELECT file_path, CASE WHEN len(t) > target AND len(t) > 20 THEN list_transform(range(0, k), lambda i: t[floor(i * len(t) / k)::INTEGER + 1]) ELSE t END AS kept FROM k"""
)
def reduce_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = FrameConfig(target_fps=0.01, max_scene_frames=20)
    return _videos(spark, sf_dir).select("file_path", F.transform(frames.reduced_frames(F.col("frames"), F.col("duration"), cfg), lambda f: f["ts"]).alias("kept"))


# --- templates, transfers, reports ----------------------------------------------------------------

TEMPLATES = {
    "dated": "{D.YYYY}/{D.MM}/{D.DD}/{NAME}{EXT}",
    "located": "{HAS.GEO}/{HAS.CAM}/{GEO}/{CAM}/{NAME.L}_{D.HH}{D.mm}{EXT}",
    "weekly": "{TYPE}/{HAS.DATE}/{I.YYYY}-W{I.WW}/{I.MMMM} {I.MMM} {I.DDDD} {I.DDD}/{F.h}{F.m}{F.s}{F.a}{F.A}",
    "unknown": "{NOPE}/{D.YY}-{D.M}-{D.D}-{D.H}-{D.hh}{D.ss}/{NAME.U}",
}
STEM_SQL = "regexp_extract(regexp_extract(file_path, '([^/]*)$', 1), '^(.+)[.][^.]*$', 1)"
DOT_SQL = "regexp_extract(file_path, '([.][^./]*)$', 1)"
TWO_SQL = "{0}::DECIMAL(20,6)::DECIMAL(20,2)"
TEMPLATE_SQL = f"""t AS (SELECT *, coalesce(image_date, created_at) AS dd, {STEM_SQL} AS stem, {DOT_SQL} AS dot, coalesce(gps_latitude, 0) <> 0 AND coalesce(gps_longitude, 0) <> 0 AS geo, coalesce(camera_model, '') AS cam FROM m_near),
weekly AS (SELECT file_path, CASE WHEN image_date IS NULL THEN '-W' ELSE strftime(image_date, '%G')[1:0] || strftime(image_date, '%Y') || '-W' || strftime(image_date, '%V') END AS w,
  coalesce(strftime(image_date, '%B %b %A %a'), '   ') AS days FROM m_near),
named AS (
  SELECT 'dated' AS template, t.file_path, 'library/' || strftime(dd, '%Y/%m/%d') || '/' || stem || dot AS target FROM t
  UNION ALL SELECT 'located', t.file_path, 'library/' || CASE WHEN geo THEN 'GeoTagged' ELSE 'NoGeo' END || CASE WHEN cam <> '' THEN '/WithCamera' ELSE '/NoCamera' END
    || CASE WHEN geo THEN '/' || {TWO_SQL.format('gps_latitude')} || '_' || {TWO_SQL.format('gps_longitude')} ELSE '' END || CASE WHEN cam <> '' THEN '/' || cam ELSE '' END || '/' || lower(stem) || '_' || strftime(dd, '%H%M') || dot FROM t
  UNION ALL SELECT 'weekly', t.file_path, 'library/' || CASE WHEN duration > 0 THEN 'Video' ELSE 'Image' END || CASE WHEN image_date IS NULL THEN '/NoDate/' ELSE '/Dated/' END || w || '/' || days || '/'
    || strftime(created_at, '%-I%-M%-S') || lower(strftime(created_at, '%p')) || strftime(created_at, '%p') || '/' || regexp_extract(t.file_path, '([^/]*)$', 1) FROM t JOIN weekly USING (file_path)
  UNION ALL SELECT 'unknown', t.file_path, 'library/{{NOPE}}/' || strftime(dd, '%y-%-m-%-d-%-H-%I%S') || '/' || upper(stem) || CASE WHEN upper(stem) LIKE '%' || dot THEN '' ELSE dot END FROM t
)"""


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = m_near(spark, sf_dir)
    out = None
    for name, text in TEMPLATES.items():
        part = files.select(F.lit(name).alias("template"), "file_path", template.compile_template(text, "library").alias("target"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {M_NEAR_SQL}, {TEMPLATE_SQL} SELECT template, file_path, target FROM named")
def template_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _targets(spark, sf_dir)


CONFLICT_SQL = "CASE WHEN row_number() OVER (PARTITION BY target ORDER BY file_path) > 1 THEN left(target, len(target) - len({dot})) || '_' || substr(md5(file_path || '|0|conflict'), 1, 8) || {dot} ELSE target END"


@query(f"WITH {M_NEAR_SQL}, {TEMPLATE_SQL}, c AS (SELECT file_path, regexp_replace(target, '_?[0-9]+[.]', '.') AS target FROM named WHERE template = 'dated') SELECT file_path, {CONFLICT_SQL.format(dot=DOT_SQL.replace('file_path', 'target'))} AS target FROM c")
def template_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = _targets(spark, sf_dir).where("template = 'dated'").select("file_path", F.regexp_replace("target", "_?[0-9]+[.]", ".").alias("target"))
    return template.settle_conflicts(same)


@query(
    f"""WITH RECURSIVE {M_NEAR_SQL}, {SETS_SQL}, {ROLES_SQL}, {TEMPLATE_SQL},
main AS (SELECT r.file_path, n.target, r.role AS reason FROM roles r JOIN named n ON r.file_path = n.file_path AND n.template = 'dated' WHERE role IN ('unique', 'representative')),
spare AS (SELECT r.file_path, 'dups/' || regexp_extract(regexp_extract(b.file_path, '([^/]*)$', 1), '^(.+)[.][^.]*$', 1) || '/' || regexp_extract(r.file_path, '([^/]*)$', 1) AS target, 'duplicate' AS reason
          FROM roles r JOIN roles b ON r.set_id = b.set_id AND b.rank = 1 WHERE r.role = 'duplicate'),
every2 AS (SELECT file_path, {CONFLICT_SQL.format(dot=DOT_SQL.replace('file_path', 'target'))} AS target, reason FROM main
           UNION ALL SELECT file_path, {CONFLICT_SQL.format(dot=DOT_SQL.replace('file_path', 'target'))}, reason FROM spare)
SELECT *, 'copy' AS action FROM every2"""
)
def transfer_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, placed = _roles(spark, sf_dir)
    return transfer.transfer_plan(files, stage(placed, "roles")[0], TransferConfig(duplicate_dir="dups"))


@query(
    f"""WITH RECURSIVE {M_NEAR_SQL}, {SETS_SQL}, {ROLES_SQL}, n AS (SELECT set_id, row_number() OVER (ORDER BY set_id) - 1 AS set_no FROM (SELECT DISTINCT set_id FROM roles WHERE set_id IS NOT NULL))
SELECT floor(set_no / 1000)::BIGINT AS page, count(DISTINCT set_id) AS n_sets, count_if(role = 'representative')::BIGINT AS n_representatives, count_if(role = 'duplicate')::BIGINT AS n_duplicates FROM roles JOIN n USING (set_id) GROUP BY 1"""
)
def report_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.page_totals(report.report_rows(stage(_roles(spark, sf_dir)[1], "roles")[0]))


# --- catalog, memo, errors ----------------------------------------------------------------------------


@query(
    """WITH old AS (SELECT doc_id, n_chars, source, 1 AS version FROM documents),
new AS (SELECT doc_id, n_chars + 1 AS n_chars, source, 2 AS version FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, n_chars + 2, source, 3 FROM documents WHERE doc_id % 4 = 0),
every AS (SELECT * FROM old UNION ALL SELECT * FROM new)
SELECT doc_id, n_chars, source, version FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY version DESC) AS n FROM every) WHERE n = 1"""
)
def catalog_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    old = d.withColumn("version", F.lit(1))
    new = d.where("doc_id % 2 = 0").withColumn("n_chars", F.col("n_chars") + 1).withColumn("version", F.lit(2))
    newer = d.where("doc_id % 4 = 0").withColumn("n_chars", F.col("n_chars") + 2).withColumn("version", F.lit(3))
    return catalog.upsert(old, new.unionByName(newer), "doc_id", "version")


@query(
    f"""WITH {M_NEAR_SQL}, keys AS (SELECT file_path FROM m_near WHERE file_path LIKE 'e/%'), least_ AS (SELECT min(file_path) AS f FROM m_near)
SELECT 'many' AS kind, file_path, phash, duration FROM m_near WHERE file_path IN (SELECT file_path FROM keys)
UNION ALL SELECT 'one', file_path, phash, duration FROM m_near WHERE file_path = 'v/IMG_0.mp4'
UNION ALL SELECT 'hash', file_path, phash, duration FROM m_near WHERE phash = (SELECT phash FROM m_near WHERE file_path = 'v/IMG_0.mp4')"""
)
def catalog_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = m_near(spark, sf_dir)
    columns = ["file_path", "phash", "duration"]
    one = catalog.by_path(f, "v/IMG_0.mp4").select(*columns)
    many = catalog.by_paths(f, f.where("file_path LIKE 'e/%'").select("file_path"), columns)
    same = f.join(F.broadcast(one.select("phash").limit(1)), "phash", "left_semi").select(*columns)
    kind = lambda d, k: d.select(F.lit(k).alias("kind"), *columns)
    return kind(many, "many").unionByName(kind(one, "one")).unionByName(kind(same, "hash"))


@query(
    f"""WITH {M_FILES_SQL}, w AS (SELECT file_path || '|' || size AS key, CASE WHEN size % 2 = 0 THEN 'c1' ELSE 'c2' END AS c FROM m_files),
e AS (SELECT file_path || '|' || size AS key, CASE WHEN size % 3 = 0 THEN 'c1' ELSE 'c2' END AS c, md5(text) AS v FROM m_files WHERE doc_id % 5 <> 0)
SELECT w.key, w.c AS config_hash, coalesce(w.c = e.c, false) AS hit, CASE WHEN w.c = e.c THEN e.v END AS value FROM w LEFT JOIN e USING (key)"""
)
def cache_hits_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = m_files(spark, sf_dir)
    key = F.concat_ws("|", "file_path", F.col("size").cast("string"))
    wanted = f.select(F.lit("stats").alias("job"), key.alias("key"), F.when(F.col("size") % 2 == 0, "c1").otherwise("c2").alias("config_hash"))
    entries = f.where("doc_id % 5 <> 0").select(F.lit("stats").alias("job"), key.alias("key"), F.when(F.col("size") % 3 == 0, "c1").otherwise("c2").alias("config_hash"), F.md5("content").alias("value"), F.lit(1).alias("seq"))
    return memo.look_up(wanted, entries).select("key", "config_hash", "hit", "value")


@query(
    f"""WITH {M_FILES_SQL}, r AS (SELECT file_path, CASE WHEN error IS NOT NULL THEN error WHEN ({FILE_TYPE_SQL}) IS NULL THEN 'ValidationError: unsupported file type ' || lower({FILE_EXT_SQL}) END AS error FROM m_files)
SELECT file_path, CASE WHEN error IS NULL THEN 'valid' ELSE 'error' END AS route, error FROM r"""
)
def error_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = m_files(spark, sf_dir).select("file_path", F.coalesce("error", paths.file_type_error(F.col("file_path"))).alias("error"))
    return f.select("file_path", F.when(F.col("error").isNull(), "valid").otherwise("error").alias("route"), "error")


# --- conversions, guards and orders --------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN md5(coalesce(text, '')) END AS hex FROM documents")
def hex_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text to bytes and back; odd lengths and other characters are null."""
    word = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    given = F.when(F.col("doc_id") % 3 == 0, F.upper(word)).when(F.col("doc_id") % 3 == 1, F.substring(word, 1, 7)).otherwise(F.concat(F.lit("zz"), word))
    return table(spark, sf_dir, "documents").select("doc_id", bits.to_hex(bits.from_hex(given)).alias("hex"))


@query(
    f"""WITH {M_NEAR_SQL}, f AS (SELECT *, phash[1] = '0' AS gone FROM m_near), q AS (SELECT * FROM m_near WHERE file_path = 'v/IMG_0.mp4')
SELECT p.file_path, CASE WHEN p.gone THEN 0.0::DOUBLE ELSE 1 - ({DISTANCE_SQL}) / 64.0::DOUBLE END AS similarity,
1 - (bit_count(xor(p.b1, q.b1)) + bit_count(xor(p.b2, q.b2)) + bit_count(p.b3) + bit_count(p.b4)) / 64.0::DOUBLE AS to_shorter,
greatest(0.0::DOUBLE, 1 - (bit_count(xor(p.b1, q.b1)) + bit_count(xor(p.b2, q.b2)) + bit_count(p.b3) + bit_count(p.b4)) / 32.0::DOUBLE) AS from_shorter FROM f p, q"""
)
def image_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file against one: by numbers, where a missing hash gives 0, and by bytes of unequal length, where the first's length counts."""
    f = m_near(spark, sf_dir)
    one = f.where("file_path = 'v/IMG_0.mp4'").select(F.col("bits").alias("q"), F.unhex(F.substring("phash", 1, 8)).alias("short"))
    both, own = f.join(F.broadcast(one)), F.unhex("phash")
    given = F.when(~F.col("phash").startswith("0"), F.col("bits"))
    return both.select("file_path", similarity.image_similarity(given, F.col("q")).alias("similarity"), similarity.image_similarity_binary(own, F.col("short")).alias("to_shorter"), similarity.image_similarity_binary(F.col("short"), own).alias("from_shorter"))


@query(
    f"""WITH {M_NEAR_SQL} SELECT file_path, md5(file_path) AS content_hash, size, width, height, duration, image_date, CASE WHEN size % 3 <> 0 THEN phash END AS phash,
CASE WHEN size % 3 <> 0 THEN phash[1:4] END AS lsh_key1, CASE WHEN size % 3 <> 0 THEN 1 ELSE 0 END AS n_frames FROM m_near"""
)
def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Infos to catalog rows and back: of the frames the first is kept, if there is any."""
    seen = F.array(F.struct(F.unhex("phash").alias("hash"), F.lit(0.0).alias("timestamp")), F.struct(F.unhex(F.reverse("phash")).alias("hash"), F.lit(1.0).alias("timestamp")))
    infos = m_near(spark, sf_dir).withColumn("content_hash", F.unhex(F.md5("file_path"))).withColumn("modified_at", F.col("created_at"))
    rows = catalog.to_rows(infos.withColumn("frames", F.when(F.col("size") % 3 != 0, seen).otherwise(F.slice(seen, 1, 0))).drop("phash"))
    back = catalog.to_infos(rows).join(rows.select("file_path", "lsh_key1"), "file_path")
    return back.select("file_path", bits.to_hex(F.col("content_hash")).alias("content_hash"), "size", "width", "height", "duration", "image_date", bits.to_hex(F.get(F.col("frames"), F.lit(0))["hash"]).alias("phash"), "lsh_key1", F.size("frames").alias("n_frames"))


@query(
    f"""WITH RECURSIVE {M_NEAR_SQL}, {SETS_SQL}, {ROLES_SQL}, bad AS (SELECT DISTINCT set_id FROM roles WHERE size % 13 = 0 AND set_id IS NOT NULL)
SELECT file_path, r.set_id, CASE WHEN b.set_id IS NOT NULL THEN 'error' ELSE role END AS role FROM roles r LEFT JOIN bad b ON r.set_id = b.set_id"""
)
def error_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set in which a file failed is not settled: its members have the role error."""
    files = stage(m_near(spark, sf_dir), "files")[0]
    sets = stage(cluster.duplicate_sets(files, SimilarityConfig()), "sets")[0]
    return select.roles(files, sets, SimilarityConfig(), files.where("size % 13 = 0")).select("file_path", "set_id", "role")


SOME_SQL = f"m_some AS (SELECT * FROM m_near WHERE size % 5 <> 0), {SETS_SQL.replace('m_near', 'm_some')}"


@query(f"WITH RECURSIVE {M_NEAR_SQL}, {SOME_SQL} SELECT m.file_path, s.set_id, s.set_id IS NULL AS is_unique FROM m_near m LEFT JOIN sets s USING (file_path)")
def files_without_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that have no hash are in no set and unique."""
    lost = F.col("size") % 5 == 0
    files = stage(m_near(spark, sf_dir).withColumn("bits", F.when(~lost, F.col("bits"))).withColumn("phash", F.when(~lost, F.col("phash"))), "files")[0]
    placed = select.roles(files, stage(cluster.duplicate_sets(files, SimilarityConfig()), "sets")[0], SimilarityConfig())
    return placed.select("file_path", "set_id", (F.col("role") == "unique").alias("is_unique"))


@query(f"WITH {M_FILES_SQL} SELECT file_path, 'bad/' || regexp_extract(file_path, '([^/]*)$', 1) AS target, 'error' AS reason, 'move' AS action FROM m_files WHERE error IS NOT NULL")
def error_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with an error go to the error folder by their names."""
    none = m_near(spark, sf_dir).limit(0)
    placed = none.select("file_path", *[F.lit(None).cast(t).alias(c) for c, t in (("set_id", "string"), ("role", "string"), ("rank", "int"))])
    return transfer.transfer_plan(none, placed, TransferConfig(error_dir="bad", move=True), m_files(spark, sf_dir).where("error IS NOT NULL"))


@query(
    f"""WITH RECURSIVE {M_NEAR_SQL}, {SETS_SQL}, {ROLES_SQL}, d AS (SELECT * FROM roles WHERE role = 'duplicate')
SELECT count(*) > 0 AS with_any, (SELECT count(*) > 0 FROM d) AS duplicates_with_folder, false AS duplicates_without, true AS errors_with_folder FROM roles WHERE role IN ('unique', 'representative')"""
)
def transfer_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a transfer has anything to do, for all files, for duplicates with and without a folder, and for errors."""
    placed = stage(_roles(spark, sf_dir)[1], "roles")[0]
    spare, bad = placed.where("role = 'duplicate'"), placed.select("file_path")
    gates = [transfer.anything_to_do(placed, TransferConfig()), transfer.anything_to_do(spare, TransferConfig(duplicate_dir="d")), transfer.anything_to_do(spare, TransferConfig()), transfer.anything_to_do(placed.limit(0), TransferConfig(error_dir="e"), bad)]
    return spark.createDataFrame([tuple(gates)], "with_any boolean, duplicates_with_folder boolean, duplicates_without boolean, errors_with_folder boolean")


@query(
    f"""WITH RECURSIVE {M_NEAR_SQL}, {SETS_SQL}, {ROLES_SQL}, n AS (SELECT set_id, row_number() OVER (ORDER BY set_id) - 1 AS set_no FROM (SELECT DISTINCT set_id FROM roles WHERE set_id IS NOT NULL))
SELECT set_no, rank::INTEGER AS place, file_path, role FROM roles JOIN n USING (set_id)"""
)
def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of the report in the order of their ids, members by score."""
    return report.report_rows(stage(_roles(spark, sf_dir)[1], "roles")[0]).select("set_no", "place", "file_path", "role")


@query(
    f"""WITH {M_NEAR_SQL}, r AS (SELECT file_path, size, substr(md5(file_path || '|0'), 1, 8) AS rnd, {STEM_SQL} AS stem, {DOT_SQL} AS dot FROM m_near)
SELECT 'cleaned' AS template, file_path, 'library/' || rnd || '/M_' || size || '_x/' || stem || '_' || rnd || dot AS target FROM r
UNION ALL SELECT 'inner', file_path, 'library/a/b/M' || size || '/c/' || regexp_extract(file_path, '([^/]*)$', 1) FROM r
UNION ALL SELECT 'empty', file_path, 'library/NoDate/' || regexp_extract(file_path, '([^/]*)$', 1) FROM r"""
)
def template_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd characters of values, slashes of all kinds, random parts and nothing at all."""
    f, out = m_near(spark, sf_dir), None
    size = F.col("size").cast("string")
    models = {"cleaned": F.concat(F.lit("M:"), size, F.lit("|x")), "inner": F.concat(F.lit("M"), size, F.lit("//c/")), "empty": F.lit("")}
    for name, text in {"cleaned": "/{RND}//{CAM}/{NAME}_{RND}{EXT}", "inner": "a\\/b//{CAM}", "empty": "//{CAM}/"}.items():
        part = f.withColumn("camera_model", models[name]).select(F.lit(name).alias("template"), "file_path", template.compile_template(text, "library").alias("target"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    f"""WITH {M_FILES_SQL} SELECT file_path, CASE WHEN error IS NOT NULL THEN error WHEN doc_id % 3 = 0 THEN 'ExternalToolError: no metadata' WHEN doc_id % 4 = 0 THEN 'HashingError: no hash' END AS error FROM m_files"""
)
def first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the errors of reading, describing and hashing a file the first counts."""
    f = m_files(spark, sf_dir)
    done = Media(f.select("file_path", "error")).enrich(f.where("doc_id % 3 <> 0").select("file_path"), f.where("doc_id % 4 <> 0").select("file_path"))
    return done.files.select("file_path", "error")


@query(
    f"""WITH {M_FILES_SQL} SELECT file_path || '|' || size AS key, CASE WHEN doc_id % 5 <> 0 AND doc_id % 3 <> 0 THEN 'kept ' || doc_id ELSE md5(text) END AS value, NOT (doc_id % 5 <> 0 AND doc_id % 3 <> 0) AS is_new FROM m_files"""
)
def memo_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results kept under the same configuration are used; the others are made and are the new entries."""
    f = m_files(spark, sf_dir)
    key = F.concat_ws("|", "file_path", F.col("size").cast("string"))
    now, old = memo.config_hash(FrameConfig(), ("resolution",)), memo.config_hash(FrameConfig(resolution=32), ("resolution",))
    wanted = f.select(F.lit("hash").alias("job"), key.alias("key"), F.lit(now).alias("config_hash"), "content")
    kept = f.where("doc_id % 5 <> 0").select(F.lit("hash").alias("job"), key.alias("key"), F.when(F.col("doc_id") % 3 == 0, old).otherwise(now).alias("config_hash"), F.concat(F.lit("kept "), F.col("doc_id").cast("string")).alias("value"), F.lit(1).alias("seq"))
    every, fresh = memo.memoize(wanted, kept, lambda missing: missing.withColumn("value", F.md5("content")))
    return every.join(fresh.select("key", F.lit(True).alias("made")), "key", "left").select("key", "value", F.coalesce("made", F.lit(False)).alias("is_new"))


# users whose number divides by 3 are images, the others videos; hashes count as 64 bits wide
DISPATCH_SQL = VIDEO_SQL.replace("), 16)", "), 64)").replace("/ 16.0::DOUBLE", "/ 64.0::DOUBLE").replace("ON b.u = a.u + 1)", "ON b.u = a.u + 1 WHERE a.u % 3 <> 0 AND b.u % 3 <> 0)")


@query(
    f"""WITH RECURSIVE {DISPATCH_SQL}
SELECT a, b, round(coalesce(similarity, 0), 9) AS similarity, 0.93::DOUBLE AS threshold FROM p LEFT JOIN best USING (a, b)
UNION ALL
SELECT i.file_path, o.file_path, round(list_max(list_transform(o.sh, lambda h: 1 - bit_count(xor(i.sh[1], h)) / 64.0::DOUBLE)), 9), 0.93::DOUBLE FROM v i JOIN v o ON o.u = i.u + 1 WHERE i.u % 3 = 0
UNION ALL
SELECT o.file_path, i.file_path, round(list_max(list_transform(o.sh, lambda h: 1 - bit_count(xor(i.sh[1], h)) / 64.0::DOUBLE)), 9), 0.93::DOUBLE FROM v o JOIN v i ON i.u = o.u + 1 WHERE i.u % 3 = 0
UNION ALL
SELECT i.file_path, o.file_path, round(1 - bit_count(xor(i.sh[1], o.sh[1])) / 64.0::DOUBLE, 9), 0.99::DOUBLE FROM v i JOIN v o ON o.u = i.u + 3 WHERE i.u % 3 = 0"""
)
def media_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any two media: images by hash, image and video by the best frame, videos by time warping."""
    u = F.regexp_extract("file_path", "([0-9]+)", 1).cast("long")
    known = F.filter("frames", lambda f: f["hash"].isNotNull())
    v = _videos(spark, sf_dir).withColumn("u", u).withColumn("is_video", F.col("u") % 3 != 0)
    files = stage(v.select("u", "file_path", "is_video", F.get(known, F.lit(0))["hash"].alias("bits"), "duration", F.when(F.col("is_video"), F.col("frames")).alias("frames")), "media")[0]
    a, b = files.select("u", F.col("file_path").alias("a"), F.col("is_video").alias("va")), files.select(F.col("u").alias("w"), F.col("file_path").alias("b"), F.col("is_video").alias("vb"))
    pairs = a.join(b, F.col("w") == F.col("u") + 1).select("a", "b").union(a.join(b, F.col("w") == F.col("u") + 3).where("NOT va").select("a", "b"))
    found = dispatch.media_similarity(pairs, files, SimilarityConfig())
    return found.withColumn("similarity", F.round("similarity", 9))


FLAGSHIP = dedup_roles
