"""Every query of the engine over its whole tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Observation, Window
from pyspark.sql import functions as F

from lodestar.functions.sam import mark_duplicate, parse_read, read_line, region_key
from lodestar.operators import contigs, dedup, graph, merge, partition, profile, regions, staged, strides, vector
from lodestar.operators.vector_store import VectorStore
from lodestar.plans import views as v
from lodestar.sinks import reads as sinks
from lodestar.sinks.sorted_reads import write_sorted
from lodestar.sources import text as sources
from lodestar.storage import local, new_path, remove, settle
from lodestar.streaming import frames as streams
from lodestar.streaming.state import keep_totals, last_totals, running_totals

PARTITIONS, REGION_PARTITIONS, TILE, RADIUS, K, LEAF_ROWS = 32, 16, 10_000_000, 1.25, 10, 1000

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


READS = """reads AS (SELECT CAST(l_orderkey AS VARCHAR) AS qname, CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS dedup_key,
 CAST(l_linenumber * 16 AS INTEGER) AS flag, l_returnflag || l_linestatus AS rname, CAST(l_partkey AS BIGINT) * 100003 + CAST(l_orderkey AS BIGINT) AS pos,
 CAST(l_suppkey % 8 AS INTEGER) AS file, CAST((l_suppkey % 8) // 3 AS INTEGER) AS batch FROM lineitem)"""
KEYS = READS + ", keys AS (SELECT DISTINCT qname, dedup_key FROM reads)"
DUP = KEYS + ", dup AS (SELECT dedup_key, count(*) - 1 AS n_extra, min(qname) AS rep_qname FROM keys GROUP BY dedup_key HAVING count(*) >= 2)"
CONTIGS = READS + """, contigs AS (SELECT rname, row_number() OVER (ORDER BY rname) AS idx, length FROM (SELECT rname, max(pos) + 1 AS length FROM reads GROUP BY rname))"""
MARK = "CASE WHEN {0} THEN flag | 1024 ELSE flag END AS flag, {0} AS is_dup"


@query(f"WITH {DUP} SELECT * FROM dup")
def dup_keys_representative(s, d):
    return dedup.duplicate_keys(v.keys(s, d))


@query(f"WITH {KEYS} SELECT dedup_key, count(*) - 1 AS n_extra, string_agg(qname, ',' ORDER BY qname) AS members FROM keys GROUP BY dedup_key HAVING count(*) >= 2")
def dup_keys_members(s, d):
    return dedup.duplicate_members(v.keys(s, d)).withColumn("members", F.array_join("members", ","))


@query(f"WITH {KEYS} SELECT dedup_key, qname FROM (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY qname) AS k FROM keys) WHERE k > 1")
def dup_nonfirst_members(s, d):
    return dedup.nonfirst_members(v.keys(s, d))


@query(f"WITH {KEYS} SELECT CAST(sum(n) AS BIGINT) AS excess FROM (SELECT count(*) - 1 AS n FROM keys GROUP BY dedup_key)")
def dup_excess_total(s, d):
    return profile.excess(v.keys(s, d))


@query(f"WITH {READS} SELECT dedup_key, count(*) - 1 AS n_extra FROM reads GROUP BY dedup_key HAVING count(*) >= 3")
def key_multiplicity_ge3(s, d):
    return profile.key_multiplicity(v.plain_reads(s, d), 3)


@query(f"WITH {KEYS} SELECT dedup_key, count(*) - 1 AS n_extra, min(qname) AS rep_qname FROM keys GROUP BY dedup_key HAVING count(*) >= 4")
def dup_keys_ge4(s, d):
    return dedup.duplicate_keys(v.keys(s, d), 4)


@query(f"WITH {READS} SELECT rname, count(*) AS n FROM reads GROUP BY rname")
def contig_counts(s, d):
    return profile.contig_counts(v.plain_reads(s, d))


@query(f"WITH {READS}, c AS (SELECT file, rname, count(*) AS n FROM reads GROUP BY file, rname) SELECT rname, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY rname")
def contig_counts_rollup(s, d):
    return profile.rollup_counts(profile.contig_counts(v.reads(s, d), "file"))


@query(f"WITH {READS} SELECT file, rname, count(*) AS n FROM reads GROUP BY file, rname")
def contig_counts_by_file(s, d):
    return profile.contig_counts(v.reads(s, d), "file")


@query(f"WITH {READS} SELECT qname, count(*) AS n_reads, string_agg(flag || ':' || rname || ':' || pos, ',' ORDER BY flag, rname, pos) AS reads FROM reads GROUP BY qname")
def reads_by_qname(s, d):
    out = dedup.group_reads(v.plain_reads(s, d))
    shown = F.transform("reads", lambda r: F.concat_ws(":", r["flag"].cast("string"), r["rname"], r["pos"].cast("string")))
    return out.withColumn("reads", F.array_join(shown, ","))


@query(f"WITH {READS} SELECT batch, count(DISTINCT qname) AS n_qnames FROM reads GROUP BY batch")
def qname_count_per_batch(s, d):
    return profile.qnames_by_batch(v.batched(s, d))


_M1 = f"WITH {DUP}, m AS (SELECT r.*, coalesce(r.qname <> d.rep_qname, false) AS hit FROM reads r LEFT JOIN dup d ON r.dedup_key = d.dedup_key)"


@query(f"{_M1} SELECT count(*) AS total_reads, count(*) FILTER (hit) AS marked_reads FROM m")
def marked_read_count(s, d):
    return dedup.counts(dedup.mark_representative_kept(v.plain_reads(s, d), v.keys(s, d)))


@query(f"{_M1} SELECT count(*) AS total_reads, count(*) FILTER (hit) AS marked_reads, count(*) FILTER (hit) AS marked_written FROM m")
def marked_counts_observed(s, d):
    """The counts come with the write of the marked reads; what was written is counted beside them."""
    path, seen = new_path(s, "marked"), Observation("marked")
    dedup.observed(dedup.mark_representative_kept(v.plain_reads(s, d), v.keys(s, d)), seen).write.parquet(path)
    got = seen.get
    out = s.read.parquet(path).agg(F.lit(got["total_reads"]).alias("total_reads"), F.lit(got["marked_reads"]).alias("marked_reads"), F.count_if(F.col("flag").bitwiseAND(1024) > 0).alias("marked_written"))
    return out


@query(f"{_M1} SELECT CAST(batch AS INTEGER) AS loop, count(*) AS n_reads, count(*) FILTER (hit) AS n_marked, count(*) FILTER (hit) AS n_marked_written, CAST(1 AS BIGINT) AS n_headers FROM m GROUP BY batch")
def stride_loop(s, d):
    """Eight read files, three in a stride, marked against all keys; stopped after one stride and started again."""
    source, out = new_path(s, "files"), new_path(s, "strides")
    r = v.reads(s, d).withColumn("pid", F.col("file"))
    write_sorted(r, source, 8, value=F.concat("dedup_key", F.lit(" lane@"), read_line(F.col("qname"), F.col("flag"), F.col("rname"), F.col("pos"))))
    files = strides.strides_of(s, source, 3, "part-*")
    for most in (1, None):
        done = strides.mark_in_strides(s, files, v.keys(s, d), out, PARTITIONS, ["@HD\tSO:coordinate"], most=most)
    lines = sources.read_lines(s, f"{out}/loop*/part-*").withColumn("loop", F.regexp_extract("file", r"loop(\d+)/", 1).cast("int"))
    flag = parse_read(F.col("value"))["flag"].bitwiseAND(1024) > 0
    read = lines.where("value not like '@%'").groupBy("loop").agg(F.count_if(flag).alias("n_marked_written"))
    heads = lines.where("value like '@%'").groupBy("loop").agg(F.countDistinct("value").alias("n_headers"))
    got = settle(done.join(read, "loop").join(heads, "loop"), "strides")
    remove(s, source)
    remove(s, out)
    return got


@query(f"{_M1} SELECT qname, dedup_key, rname, pos, {MARK.format('hit')} FROM m")
def mark_dups(s, d):
    return dedup.mark_representative_kept(v.plain_reads(s, d), v.keys(s, d))


@query(f"""WITH {DUP}, h AS (SELECT *, first_value(qname) OVER (PARTITION BY batch, dedup_key ORDER BY pos, rname, qname, flag) AS head FROM reads),
m AS (SELECT h.*, coalesce(h.head <> d.rep_qname, false) AS hit FROM h LEFT JOIN dup d ON h.dedup_key = d.dedup_key)
SELECT qname, dedup_key, rname, pos, batch, {MARK.format('hit')} FROM m""")
def mark_dups_group_head(s, d):
    return dedup.mark_group_head(v.batched(s, d), v.keys(s, d))


@query(f"""WITH {KEYS}, good AS (SELECT * FROM keys WHERE CAST(qname AS BIGINT) % 5 <> 0),
q AS (SELECT DISTINCT qname FROM good WHERE dedup_key IN (SELECT dedup_key FROM good GROUP BY dedup_key HAVING count(*) >= 2)),
m AS (SELECT *, qname IN (SELECT qname FROM q) AS hit FROM reads) SELECT qname, dedup_key, rname, pos, {MARK.format('hit')} FROM m""")
def mark_dups_all_mapped(s, d):
    return dedup.mark_all_mapped(v.plain_reads(s, d), v.keys4(s, d))


@query(f"WITH {DUP}, m AS (SELECT *, qname IN (SELECT rep_qname FROM dup) AND rname <> '*' AS hit FROM reads) SELECT qname, dedup_key, rname, pos, {MARK.format('hit')} FROM m")
def mark_dups_rep_only(s, d):
    return dedup.mark_representatives(v.plain_reads(s, d), v.keys(s, d))


_TAGGED = "WITH {0}, m AS (SELECT *, dedup_key IN (SELECT dedup_key FROM keys GROUP BY dedup_key HAVING count(*) >= {1}) AS hit FROM reads) SELECT qname, dedup_key, rname, pos, {2} FROM m"


@query(_TAGGED.format(KEYS, 3, MARK.format("hit")))
def mark_dups_tagged(s, d):
    return dedup.mark_tagged(v.plain_reads(s, d), v.keys(s, d), 3)


@query(_TAGGED.format(KEYS, 2, MARK.format("hit")))
def mark_dups_tagged_ge2(s, d):
    return dedup.mark_tagged(v.plain_reads(s, d), v.keys(s, d), 2)


@query(f"WITH {READS}, m AS (SELECT *, count(*) OVER (PARTITION BY qname) > 1 AS hit FROM reads) SELECT qname, dedup_key, rname, pos, {MARK.format('hit')} FROM m")
def mark_multiread_qname(s, d):
    return dedup.mark_multiread(v.plain_reads(s, d))


@query("""WITH reads AS (SELECT CAST(doc_id AS VARCHAR) AS qname, md5(text) AS dedup_key, 0 AS flag, lang AS rname, CAST(n_chars AS BIGINT) AS pos FROM documents),
dup AS (SELECT dedup_key, min(qname) AS rep FROM reads GROUP BY dedup_key HAVING count(DISTINCT qname) >= 2),
m AS (SELECT r.*, coalesce(r.qname <> d.rep, false) AS hit FROM reads r LEFT JOIN dup d ON r.dedup_key = d.dedup_key)
SELECT qname, dedup_key, rname, pos, CASE WHEN hit THEN flag | 1024 ELSE flag END AS flag, hit AS is_dup FROM m""")
def doc_mark_dups(s, d):
    r = v.doc_reads(s, d)
    return dedup.mark_representative_kept(r, r.select("qname", "dedup_key").distinct())


@query(f"""WITH {CONTIGS} SELECT r.qname, r.dedup_key, r.flag, r.rname, r.pos, c.idx * 1000 + r.pos // 100000000 AS coarse, c.idx * 1000000 + r.pos // 1000000 AS fine,
c.idx * 10000 + r.pos % 1000 AS modulo FROM reads r JOIN contigs c ON r.rname = c.rname""")
def region_keys(s, d):
    out = v.plain_reads(s, d).join(v.contigs(s, d).select("rname", "idx"), "rname", "left")
    for kind in ("coarse", "fine", "modulo"):
        out = out.withColumn(kind, region_key(F.col("idx"), F.col("pos"), kind))
    return out.drop("idx")


@query(f"""WITH {CONTIGS}, k AS (SELECT r.*, c.idx * 1000000 + r.pos // 1000000 AS region_key FROM reads r JOIN contigs c ON r.rname = c.rname)
SELECT CAST(region_key % {REGION_PARTITIONS} AS INTEGER) AS pid, count(*) AS n_reads, min(pos) AS first_pos, max(pos) AS last_pos, string_agg(DISTINCT rname, ',' ORDER BY rname) AS rnames FROM k GROUP BY 1""")
def region_partition(s, d):
    out = partition.assign_regions(v.plain_reads(s, d), v.contigs(s, d), REGION_PARTITIONS, "fine")
    laid = partition.lay_out(out, REGION_PARTITIONS).withColumn("at", F.spark_partition_id())
    return laid.groupBy(F.col("at").alias("pid")).agg(F.count("*").alias("n_reads"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.array_join(F.sort_array(F.collect_set("rname")), ",").alias("rnames"))


PLAN = f"""counts AS (SELECT rname, count(*) AS n FROM reads GROUP BY rname), e AS (SELECT greatest(1, (CAST(sum(n) AS BIGINT) // {PARTITIONS}) * 11 // 10) AS expected FROM counts),
p AS (SELECT rname, n, greatest(1, n // expected) AS parts FROM counts, e),
plan AS (SELECT rname, n, CAST(parts AS BIGINT) AS parts, CAST(coalesce(sum(parts) OVER (ORDER BY rname ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS acc FROM p)"""


@query(f"WITH {READS}, {PLAN} SELECT * FROM plan")
def partition_plan(s, d):
    return partition.plan(profile.contig_counts(v.plain_reads(s, d)), PARTITIONS)


@query(f"WITH {READS}, {PLAN} SELECT r.qname, r.dedup_key, r.flag, r.rname, r.pos, CAST(r.pos % p.parts + p.acc AS INTEGER) AS pid FROM reads r JOIN plan p ON r.rname = p.rname")
def partition_assign(s, d):
    r = v.plain_reads(s, d)
    return partition.assign(r, partition.plan(profile.contig_counts(r), PARTITIONS))


@query(f"""WITH {READS}, {PLAN}, a AS (SELECT r.rname, CAST(r.pos % p.parts + p.acc AS INTEGER) AS pid FROM reads r JOIN plan p ON r.rname = p.rname)
SELECT 'part-' || lpad(CAST(pid AS VARCHAR), 5, '0') AS part, string_agg(DISTINCT CASE WHEN rname = '*' THEN 'unmapped' ELSE rname END, ',' ORDER BY CASE WHEN rname = '*' THEN 'unmapped' ELSE rname END) AS rnames, count(*) AS n_reads FROM a GROUP BY pid""")
def partition_manifest(s, d):
    r = v.plain_reads(s, d)
    return partition.manifest(partition.assign(r, partition.plan(profile.contig_counts(r), PARTITIONS)))


@query(f"""WITH {READS}, {PLAN}, a AS (SELECT r.rname, CAST(r.pos % p.parts + p.acc AS INTEGER) AS pid FROM reads r JOIN plan p ON r.rname = p.rname)
SELECT 'part-' || lpad(CAST(pid AS VARCHAR), 5, '0') AS part, string_agg(DISTINCT CASE WHEN rname = '*' THEN 'unmapped' ELSE rname END, ',' ORDER BY CASE WHEN rname = '*' THEN 'unmapped' ELSE rname END) AS rnames, count(*) AS n_reads, CAST(1 AS BIGINT) AS n_headers FROM a GROUP BY pid""")
def sorted_reads_with_manifest(s, d):
    """Reads written by plan, with the manifest that the write's commit made: read back, with the lines of each file."""
    path, r = new_path(s, "planned"), v.plain_reads(s, d)
    planned = settle(partition.plan(profile.contig_counts(r), PARTITIONS), "plan")
    write_sorted(partition.assign(r, planned), path, partition.total_partitions(planned, PARTITIONS), ["@HD\tSO:coordinate"])
    made = sources.read_manifest(s, f"{path}/part.info").select("part", F.array_join("rnames", ",").alias("rnames"))
    lines = sources.read_lines(s, f"{path}/part-*").groupBy(F.element_at(F.split("file", "/"), -1).alias("part"))
    return made.join(lines.agg(F.count_if(~F.col("value").startswith("@")).alias("n_reads"), F.count_if(F.col("value").startswith("@")).alias("n_headers")), "part")


@query(f"WITH {CONTIGS} SELECT rname, CAST(idx AS INTEGER) AS idx, length FROM contigs UNION ALL SELECT '*', 0, 0")
def contig_dictionary(s, d):
    return v.contigs(s, d)


@query(f"WITH {READS} SELECT qname, flag | 1024 AS flag, rname, pos, qname || chr(9) || (flag | 1024) || chr(9) || rname || chr(9) || pos AS line FROM reads")
def sam_roundtrip(s, d):
    line = read_line(F.col("qname"), mark_duplicate(F.col("flag")), F.col("rname"), F.col("pos"))
    parsed = v.plain_reads(s, d).select(line.alias("line")).withColumn("r", parse_read(F.col("line")))
    return parsed.select("r.qname", "r.flag", "r.rname", "r.pos", read_line(F.col("r.qname"), F.col("r.flag"), F.col("r.rname"), F.col("r.pos")).alias("line"))


def _point(s, d):
    """The query vector and its label: one row."""
    row = v.vectors(s, d).where("vec_id = 0").select("embedding", "label").first()
    return list(row[0]), row[1]


DIST = "dist AS (SELECT e.vec_id, e.label, list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS x FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


@query(f"WITH {DIST} SELECT vec_id, label, round(x, 6) AS dist FROM dist WHERE x < {RADIUS}")
def vector_range(s, d):
    return vector.in_range(v.vectors(s, d), _point(s, d)[0], RADIUS).select("vec_id", "label", F.round("dist", 6).alias("dist"))


@query(f"WITH {DIST} SELECT CAST(row_number() OVER (ORDER BY x, vec_id) AS INTEGER) AS rank, vec_id, label, round(x, 6) AS dist FROM dist ORDER BY x, vec_id LIMIT {K}")
def vector_knn(s, d):
    return vector.nearest(v.vectors(s, d), _point(s, d)[0], K).select("rank", "vec_id", "label", F.round("dist", 6).alias("dist"))


MULTI = f"""WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS x FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id)
SELECT query_id, rank, vec_id, round(x, 6) AS dist FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY x, vec_id) AS INTEGER) AS rank FROM p) WHERE rank <= {K}"""


def _store(s, d, batches: int = 1, leaf_rows: int = LEAF_ROWS):
    """A new store of all vectors, inserted in so many batches, and its folder."""
    path, e = new_path(s, "vectors"), v.vectors(s, d)
    store = VectorStore(s, path, leaf_rows)
    for k in range(batches):
        store.insert(e.where(F.pmod("vec_id", F.lit(batches)) == k))
    return store, path


@query(MULTI)
def vector_knn_multi(s, d):
    store, path = _store(s, d)
    out = store.nearest_of_each(v.vectors(s, d).where(F.col("vec_id") % 20 == 0), K).withColumn("dist", F.round("dist", 6))
    remove(s, path)  # what was found is a table of its own
    return out


@query(MULTI)
def vector_store_inserts_knn(s, d):
    """Three inserts, with the splits that they cause, answer as one."""
    store, path = _store(s, d, 3, 100)
    out = store.nearest_of_each(v.vectors(s, d).where(F.col("vec_id") % 20 == 0), K).withColumn("dist", F.round("dist", 6))
    remove(s, path)
    return out


@query(f"""WITH {DIST} SELECT CAST(k + 1 AS INTEGER) AS version, vec_id, label, round(x, 6) AS dist FROM dist, range(3) t(k) WHERE x < {RADIUS} AND vec_id % 3 <= k""")
def vector_store_versions(s, d):
    """The range query on each version of a store that was filled by three inserts: each holds what was in by then."""
    store, q = _store(s, d, 3, 100)[0], _point(s, d)[0]
    found = [store.in_range(q, RADIUS, store.version(k)).select(F.lit(k).cast("int").alias("version"), "vec_id", "label", F.round("dist", 6).alias("dist")) for k in store.versions()]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


@query(f"WITH {DIST} SELECT vec_id, label, round(x, 6) AS dist FROM dist WHERE x < {RADIUS}")
def vector_tree_range(s, d):
    return _store(s, d)[0].in_range(_point(s, d)[0], RADIUS).select("vec_id", "label", F.round("dist", 6).alias("dist"))


@query(f"WITH {DIST} SELECT CAST(row_number() OVER (ORDER BY x, vec_id) AS INTEGER) AS rank, vec_id, label, round(x, 6) AS dist FROM dist ORDER BY x, vec_id LIMIT {K}")
def vector_tree_knn(s, d):
    return _store(s, d)[0].nearest(_point(s, d)[0], K).select("rank", "vec_id", "label", F.round("dist", 6).alias("dist"))


@query(f"WITH {DIST} SELECT label, vec_id, round(x, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY x, vec_id) AS k FROM dist) WHERE k = 1")
def vector_nearest_per_label(s, d):
    return vector.nearest_per_label(v.vectors(s, d), _point(s, d)[0]).withColumn("dist", F.round("dist", 6))


@query(f"""WITH {DIST}, r AS (SELECT max(x) AS radius FROM (SELECT x FROM dist WHERE label = (SELECT label FROM embeddings WHERE vec_id = 0) ORDER BY x DESC, vec_id LIMIT {K}))
SELECT vec_id, label, round(x, 6) AS dist FROM dist, r WHERE x < radius""")
def vector_knn_leaf_radius(s, d):
    q, leaf = _point(s, d)
    return vector.leaf_radius_range(v.vectors(s, d), q, leaf, K).select("vec_id", "label", F.round("dist", 6).alias("dist"))


TILES = CONTIGS + f""", t AS (SELECT rname AS name, unnest(range(0, length, {TILE})) AS start, length FROM contigs),
tiles AS (SELECT row_number() OVER (ORDER BY name, start) - 1 AS idx, name, start, least(start + {TILE}, length) AS "end" FROM t)"""
BAMS = TILES + """, bams AS (SELECT DISTINCT '/work/' || l_linenumber || '/' || l_returnflag || l_linestatus || '.bam' AS path, l_returnflag || l_linestatus AS rname FROM lineitem),
pairs AS (SELECT tiles.*, path FROM tiles JOIN bams ON name = rname)"""
LISTED = "string_agg(name || ':' || start || '-' || \"end\", chr(10) ORDER BY idx) AS regions"


@query(f"WITH {TILES} SELECT * FROM tiles")
def region_tiles(s, d):
    return regions.tiles(v.contigs(s, d), TILE)


def _pairs(s, d):
    return regions.with_files(regions.tiles(v.contigs(s, d), TILE), v.bams(s, d))


@query(f"WITH {BAMS} SELECT * FROM pairs")
def region_file_pairs(s, d):
    return _pairs(s, d)


@query(f"WITH {BAMS} SELECT path, count(*) AS n_regions, {LISTED} FROM pairs GROUP BY path")
def regions_by_file(s, d):
    return regions.by_file(_pairs(s, d))


@query(f"WITH {BAMS} SELECT idx, name, start, \"end\", string_agg(path, ' ' ORDER BY path) AS files FROM pairs GROUP BY idx, name, start, \"end\"")
def files_by_region(s, d):
    return regions.by_region(_pairs(s, d))


@query(f"WITH {TILES} SELECT 'region' || lpad(CAST(idx // 7 AS VARCHAR), CAST(greatest(2, length(CAST(idx // 7 AS VARCHAR))) AS INTEGER), '0') || '.txt' AS bundle, count(*) AS n_regions, {LISTED} FROM tiles GROUP BY idx // 7")
def region_bundles(s, d):
    return regions.bundles(regions.tiles(v.contigs(s, d), TILE), 7)


_VCF = "'/out/' || lpad(CAST(idx AS VARCHAR), 6, '0') || '.' || lpad(CAST(idx % 10 AS VARCHAR), 10, '0') || '.' || name || '.' || lpad(CAST(start AS VARCHAR), 13, '0') || '-' || lpad(CAST(\"end\" AS VARCHAR), 13, '0') || '.vcf'"


@query(f"""WITH {BAMS} SELECT idx, path, {_VCF} AS vcf, 'freebayes -v ' || {_VCF} || ' {regions.CALLER} -f ref.fa ' || path || ' -r ' || name || ':' || start || '-' || "end" AS command FROM pairs""")
def region_commands(s, d):
    return regions.commands(_pairs(s, d), "/out", "ref.fa")


@query(f"""WITH {BAMS}, calls AS (SELECT path, 'freebayes -v ' || {_VCF} || ' {regions.CALLER} -f ref.fa ' || path || ' -r ' || name || ':' || start || '-' || "end" AS command FROM pairs)
SELECT DISTINCT 0 AS stage, 'samtools index ' || path AS command FROM calls WHERE CAST(split_part(path, '/', 3) AS INTEGER) % 2 = 1 UNION ALL SELECT 1, command FROM calls""")
def staged_commands(s, d):
    """Files of odd passes have no index yet."""
    files = v.bams(s, d).select("path")
    indexes = files.where(F.element_at(F.split("path", "/"), 3).cast("int") % 2 == 0).select(F.concat("path", F.lit(".bai")).alias("path"))
    return staged.plan(files, indexes, region_commands(s, d).select("path", "command"))


PARTS = """parts AS (SELECT l_linenumber AS loop, 'part-' || lpad(CAST(l_suppkey % 40 AS VARCHAR), 5, '0') AS part, l_returnflag || l_linestatus AS rname, count(*) AS bytes,
 'loop-' || l_linenumber || '/part-' || lpad(CAST(l_suppkey % 40 AS VARCHAR), 5, '0') AS path FROM lineitem GROUP BY ALL)"""


@query(f"WITH {PARTS} SELECT part, CAST(sum(bytes) AS BIGINT) AS bytes FROM parts GROUP BY part")
def part_sizes(s, d):
    return v.parts(s, d).groupBy("part").agg(F.sum("bytes").alias("bytes"))


@query(f"WITH {PARTS} SELECT rname, CAST(count(DISTINCT path) AS INTEGER) AS n_files, string_agg(DISTINCT path, ' ' ORDER BY path) AS files FROM parts GROUP BY rname")
def merge_files_by_contig(s, d):
    return merge.files_by_contig(v.parts(s, d)).withColumn("files", F.array_join("files", " "))


@query(f"WITH {PARTS} SELECT path, string_agg(DISTINCT rname, ',' ORDER BY rname) AS rnames FROM parts GROUP BY path HAVING count(DISTINCT rname) > 1")
def multi_contig_parts(s, d):
    return merge.contigs_by_part(v.parts(s, d)).withColumn("rnames", F.array_join("rnames", ","))


L1 = PARTS + """, f AS (SELECT rname, path, (row_number() OVER (PARTITION BY rname ORDER BY path) - 1) // 5 AS chunk FROM (SELECT DISTINCT rname, path FROM parts)),
g AS (SELECT rname, chunk, count(*) AS n_files, string_agg(path, ' ' ORDER BY path) AS files FROM f GROUP BY rname, chunk),
l1 AS (SELECT row_number() OVER (ORDER BY rname, chunk) - 1 AS file_idx, rname, n_files, files FROM g),
merged AS (SELECT *, 'out/' || lpad(CAST(file_idx AS VARCHAR), 6, '0') || '-' || rname || '.merged' AS target FROM l1)"""


@query(f"WITH {L1} SELECT CAST(file_idx AS INTEGER) AS file_idx, rname, CAST(n_files AS INTEGER) AS n_files, target, 'samtools merge -@ 4 -c -p -O bam ' || target || ' ' || files AS command FROM merged")
def merge_plan_l1(s, d):
    return merge.level_one(merge.files_by_contig(v.parts(s, d)), "out")


ALT = PARTS + """, sizes AS (SELECT part, CAST(sum(bytes) AS BIGINT) AS bytes FROM parts GROUP BY part),
r AS (SELECT *, row_number() OVER (ORDER BY bytes DESC, part) AS rd, count(*) OVER () AS n FROM sizes),
sched AS (SELECT part, bytes, CAST(CASE WHEN rd <= (n + 1) // 2 THEN 2 * rd - 2 ELSE 2 * (n + 1 - rd) - 1 END AS INTEGER) AS seq FROM r)"""


@query(f"WITH {ALT} SELECT part, bytes, seq FROM sched")
def merge_schedule_alternating(s, d):
    return merge.alternating(part_sizes(s, d))


@query(f"""WITH {ALT}, f AS (SELECT part, path, min(rname) OVER (PARTITION BY part) AS rname, count(*) OVER (PARTITION BY part) AS n, (row_number() OVER (PARTITION BY part ORDER BY path) - 1) // 5 AS k
 FROM (SELECT part, path, min(rname) AS rname FROM parts GROUP BY part, path))
SELECT seq, f.part, CAST(k + 1 AS INTEGER) AS loop, 'samtools merge -@ 4 -O bam out/' || f.part || CASE WHEN n > 5 THEN CAST(k + 1 AS VARCHAR) ELSE '' END || '-' || rname || '.merged ' || string_agg(path, ' ' ORDER BY path) AS command
FROM f JOIN sched ON f.part = sched.part GROUP BY seq, f.part, k, n, rname""")
def merge_plan_parts(s, d):
    return merge.part_commands(v.parts(s, d), merge.alternating(part_sizes(s, d)), "out")


@query(f"""WITH {L1}, b AS (SELECT rname, count(*) AS n, string_agg(target, ' ' ORDER BY target) AS files FROM merged GROUP BY rname),
o AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN n > 1 THEN 0 ELSE 1 END, CASE WHEN n = 1 AND rname = '*' THEN 1 ELSE 0 END, rname) - 1 AS out_idx FROM b)
SELECT CAST(out_idx AS INTEGER) AS out_idx, rname, CASE WHEN n > 1 THEN 'merge' ELSE 'move' END AS action, CAST(n AS INTEGER) AS n_files,
CASE WHEN n > 1 THEN 'samtools merge -c -p -O bam fin/Output' || out_idx || '.bam ' || files ELSE 'mv ' || files || ' fin/Output' || out_idx || '.bam' END AS command FROM o""")
def merge_plan_l2(s, d):
    return merge.level_two(merge.level_one(merge.files_by_contig(v.parts(s, d)), "out"), "fin")


EDGES = """edges AS (SELECT CAST(c_nationkey AS INTEGER) AS src, CAST(s_nationkey AS INTEGER) AS dst, count(*) AS w FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey AND (c_nationkey * 7 + s_nationkey) % 5 = 0 GROUP BY 1, 2), d0 AS (SELECT src, dst, w AS dist FROM edges)"""
for _k in range(5):
    EDGES += f", d{_k + 1} AS (SELECT src, dst, min(dist) AS dist FROM (SELECT * FROM d{_k} UNION ALL SELECT a.src, b.dst, a.dist + b.dist FROM d{_k} a JOIN d{_k} b ON a.dst = b.src) GROUP BY src, dst)"


@query(f"WITH {EDGES} SELECT src, dst, dist FROM d5")
def shortest_paths(s, d):
    return graph.shortest_paths(v.edges(s, d))


@query(f"""WITH RECURSIVE {EDGES}, nxt AS (SELECT p.src, p.dst, p.dist, min(e.dst) AS via FROM d5 p JOIN edges e ON e.src = p.src LEFT JOIN d5 r ON r.src = e.dst AND r.dst = p.dst
 WHERE p.src <> p.dst AND ((e.dst = p.dst AND e.w = p.dist) OR (e.dst <> p.dst AND e.w + r.dist = p.dist)) GROUP BY p.src, p.dst, p.dist),
walk AS (SELECT src, dst, dist, via AS place, 1 AS hops, src || '>' || via AS route FROM nxt UNION ALL
 SELECT w.src, w.dst, w.dist, n.via, w.hops + 1, w.route || '>' || n.via FROM walk w JOIN nxt n ON n.src = w.place AND n.dst = w.dst WHERE w.place <> w.dst)
SELECT src, dst, dist, hops, route FROM walk WHERE place = dst""")
def shortest_path_routes(s, d):
    e = v.edges(s, d)
    return graph.routes(e, graph.shortest_paths(e))


@query(f"WITH {EDGES} SELECT count(*) FILTER (dist < 0) > 0 AS has_negative_cycle, count(*) FILTER (dist < 0) AS n_vertices, min(dist) AS least_cycle FROM d5 WHERE src = dst")
def negative_cycle_check(s, d):
    return graph.negative_cycles(graph.shortest_paths(v.edges(s, d)))


@query(f"""WITH {CONTIGS}, k AS (SELECT r.*, c.idx * 1000 + r.pos // 100000000 AS region_key FROM reads r JOIN contigs c ON r.rname = c.rname)
SELECT region_key, CAST(region_key % {REGION_PARTITIONS} AS INTEGER) AS pid, count(*) AS n_reads, count(DISTINCT qname) AS n_qnames, CAST(sum(pos) AS BIGINT) AS sum_pos FROM k GROUP BY region_key""")
def stream_region_batches(s, d):
    source, out, offsets = new_path(s, "frames"), new_path(s, "regions"), new_path(s, "offsets")
    v.frames(s, d).write.text(source)
    streams.run_regions(streams.frame_stream(s, source, files_per_batch=4), v.contigs(s, d), out, offsets, REGION_PARTITIONS)
    got = s.read.schema("pid int, region_key bigint, value string").parquet(f"{out}/stream-*/reads").select("pid", "region_key", parse_read(F.col("value")).alias("r"))
    got = settle(got.groupBy("region_key", "pid").agg(F.count("*").alias("n_reads"), F.countDistinct("r.qname").alias("n_qnames"), F.sum("r.pos").alias("sum_pos")), "regions-counted")
    for path in (source, out, offsets):
        remove(s, path)
    return got


@query("SELECT CAST(count(*) AS BIGINT) AS n_frames FROM lineitem")
def stream_frame_count(s, d):
    source, out = new_path(s, "frames"), new_path(s, "counts")
    v.frames(s, d).write.text(source)
    streams.count_frames(streams.frame_stream(s, source, files_per_batch=4), out, new_path(s, "offsets"))
    remove(s, source)
    return last_totals(s, out).select(F.col("total").alias("n_frames"))


@query(f"""WITH {CONTIGS}, k AS (SELECT r.*, c.idx * 1000 + r.pos // 100000000 AS region_key FROM reads r JOIN contigs c ON r.rname = c.rname)
SELECT region_key, CAST(region_key % {REGION_PARTITIONS} AS INTEGER) AS pid, count(*) AS n_reads FROM k GROUP BY region_key""")
def stream_header_control(s, d):
    """The dictionary comes from the stream's own header, and the stream ends at its end line."""
    source, out = new_path(s, "frames"), new_path(s, "regions")
    header = v.contigs(s, d).where("idx > 0").orderBy("idx").select(F.concat(F.lit("@SQ\tSN:"), "rname").alias("value"))
    header.coalesce(1).write.text(source)
    v.frames(s, d).write.mode("append").text(source)
    s.createDataFrame([("##end",)], "value string").coalesce(1).write.mode("append").text(source)
    streams.run_regions(streams.frame_stream(s, source), None, out, new_path(s, "offsets"), REGION_PARTITIONS, interval="1 second")
    remove(s, source)
    return s.read.schema("pid int, region_key bigint").parquet(f"{out}/stream-*/reads").groupBy("region_key", "pid").agg(F.count("*").alias("n_reads"))


@query(f"""WITH {CONTIGS}, k AS (SELECT r.*, CASE WHEN c.idx <= 3 THEN c.idx ELSE 0 END * 1000 + r.pos // 100000000 AS region_key FROM reads r JOIN contigs c ON r.rname = c.rname)
SELECT CASE WHEN region_key < 1000 THEN 0 ELSE region_key END AS region_key, count(*) AS n_reads FROM k GROUP BY 1""")
def stream_header_frozen(s, d):
    """Header lines that come after the first reads change nothing, also if the stream was stopped and started again in between."""
    source, out, offsets = new_path(s, "frames"), new_path(s, "regions"), new_path(s, "offsets")
    for k in range(2):
        header = v.contigs(s, d).where("idx between 1 and 3" if k == 0 else "idx > 0").orderBy("idx").select(F.concat(F.lit("@SQ\tSN:"), "rname").alias("value"))
        header.coalesce(1).write.mode("append").text(source)
        v.frames(s, d).where(F.pmod(F.xxhash64("value"), F.lit(2)) == k).write.mode("append").text(source)
        streams.run_regions(streams.frame_stream(s, source), None, out, offsets, REGION_PARTITIONS)
    got = settle(s.read.schema("pid int, region_key bigint").parquet(f"{out}/stream-*/reads").select(F.when(F.col("region_key") >= 1000, F.col("region_key")).otherwise(0).alias("region_key")).groupBy("region_key").agg(F.count("*").alias("n_reads")), "totals")
    for path in (source, out, offsets):
        remove(s, path)
    return got


@query(f"WITH {READS} SELECT rname, count(*) AS total FROM reads GROUP BY rname")
def stream_contig_totals(s, d):
    """Reads of each contig, in keyed state: the stream is stopped and started again from its checkpoint."""
    source, out, offsets = new_path(s, "frames"), new_path(s, "totals"), new_path(s, "offsets")
    for k in range(2):
        v.frames(s, d).where(F.pmod(F.xxhash64("value"), F.lit(2)) == k).write.mode("append").text(source)
        keep_totals(running_totals(streams.reads_of_frames(streams.frame_stream(s, source, files_per_batch=8)), "rname"), out, offsets)
    got = settle(last_totals(s, out).select(F.col("key").alias("rname"), "total"), "totals")
    for path in (source, out, offsets):
        remove(s, path)
    return got


# written in a format of the engine, and read again


@query(f"WITH {CONTIGS} SELECT rname, CAST(idx AS INTEGER) AS idx FROM contigs UNION ALL SELECT '*', 0")
def header_dictionary(s, d):
    return contigs.dictionary_of_header(sources.read_header(s, _with_header(s, d)))


def _with_header(s, d) -> str:
    """A folder of files: one that begins with a header with repeated lines and lines of no use, and the reads."""
    path = new_path(s, "header")
    sq = v.contigs(s, d).where("idx > 0").select(F.concat(F.lit("@SQ\tSN:"), "rname").alias("value"), F.col("idx").alias("n"))
    rg = v.reads(s, d).select(F.concat(F.lit("@RG\tID:"), F.col("file").cast("string")).alias("value"), (F.col("file") + 2000).alias("n")).distinct()
    more = local(s, [("@HD\tSO:coordinate", -1), ("@PG\tID:x", 5000)], "value string, n int")
    sq.unionByName(sq.withColumn("n", F.col("n") + 1000)).unionByName(rg).unionByName(more).coalesce(1).sortWithinPartitions("n").select("value").write.text(path)
    v.frames(s, d).write.mode("append").text(path)
    return path


@query(f"WITH {CONTIGS} SELECT '@SQ' || chr(9) || 'SN:' || rname AS value FROM contigs UNION ALL SELECT '@RG' || chr(9) || 'ID:' || min(file) FROM reads")
def header_lines_kept(s, d):
    return contigs.kept_header(sources.read_header(s, _with_header(s, d))).select("value")


@query(f"WITH {READS} SELECT count(*) AS n_reads, CAST(0 AS BIGINT) AS n_overlaps, CAST(0 AS BIGINT) AS n_unsorted FROM reads")
def reads_in_ranges(s, d):
    """Reads laid out by ranges of position: files whose ranges overlap, and reads out of order in a file."""
    path = new_path(s, "ranges")
    partition.lay_out_by_range(v.plain_reads(s, d), v.shares(s, d, REGION_PARTITIONS), "pos").write.parquet(path)
    rows = s.read.parquet(path).select("pos", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    seen = rows.withColumn("before", F.lag("pos").over(Window.partitionBy("file").orderBy("at")))
    by = seen.groupBy("file").agg(F.count("*").alias("n"), F.min("pos").alias("low"), F.max("pos").alias("high"), F.count_if(F.col("before") > F.col("pos")).alias("unsorted"))
    by = by.withColumn("before", F.lag("high").over(Window.orderBy("low")))  # over a row for each file
    return by.agg(F.sum("n").alias("n_reads"), F.count_if(F.col("before") >= F.col("low")).alias("n_overlaps"), F.sum("unsorted").alias("n_unsorted"))


@query(f"WITH {KEYS} SELECT dedup_key FROM keys")
def scalar_text(s, d):
    """One value a line, and whole lines read as keys."""
    path = new_path(s, "scalar")
    v.keys(s, d).select("dedup_key").write.text(path)
    return sources.read_keys(s, path, 1)


@query(f"""WITH {CONTIGS} SELECT qname, flag, r.rname, pos, CAST((c.idx * 1000 + r.pos // 100000000) % {REGION_PARTITIONS} AS INTEGER) AS pid FROM reads r JOIN contigs c ON r.rname = c.rname""")
def headerless_text_files(s, d):
    path, r = new_path(s, "headerless"), v.plain_reads(s, d)
    sinks.write_reads(partition.assign_regions(r, v.contigs(s, d), REGION_PARTITIONS), path, REGION_PARTITIONS)
    got, _ = sources.read_reads(s, path)
    return got.select("qname", "flag", "rname", "pos", F.regexp_extract("file", r"part-(\d+)", 1).cast("int").alias("pid"))


INTEGERS = "list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000) AS INTEGER))"


def _vector_text(s, d, *more) -> str:
    path = new_path(s, "vector-text")
    numbers = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * 1000).cast("string"))
    v.vectors(s, d).select(F.concat_ws(" ", numbers, *more).alias("value")).write.text(path)
    return path


@query(f"SELECT CAST(label AS VARCHAR) AS label, count(*) AS n, CAST(min(len(embedding)) AS INTEGER) AS dimension, CAST(sum(list_sum({INTEGERS})) AS BIGINT) AS total FROM embeddings GROUP BY label")
def vector_text_scan(s, d):
    """Vectors as lines of numbers with a label at the end."""
    rows = sources.read_vectors(s, _vector_text(s, d, F.col("label").cast("string")), 64)
    total = F.aggregate("features", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.min(F.size("features")).alias("dimension"), F.sum(total).alias("total"))


@query(f"SELECT array_to_string({INTEGERS}, ' ') AS features FROM embeddings")
def query_vector_scan(s, d):
    return sources.read_query_vectors(s, _vector_text(s, d)).select(F.array_join(F.col("features").cast("array<string>"), " ").alias("features"))


@query(f"""WITH {READS} SELECT 'part-' || lpad(CAST(file AS VARCHAR), 5, '0') AS name, file AS number, CAST(file // 3 AS BIGINT) AS stride, CAST(sum(strlen(qname || chr(9) || flag || chr(9) || rname || chr(9) || pos) + 1) AS BIGINT) AS length
FROM reads GROUP BY file""")
def file_catalog(s, d):
    """Names, numbers, strides and sizes of files, which are listed and not read."""
    path = new_path(s, "catalog")
    write_sorted(v.reads(s, d).withColumn("pid", F.col("file")), path, 8)
    listed = sources.list_files(s, path, "part-*")
    return listed.select("name", sources.file_number(F.col("name")).alias("number"), sources.batch_number(F.col("name"), 3).alias("stride"), "length")


@query(f"WITH {READS} SELECT dedup_key, qname, flag, rname, pos FROM reads")
def keyed_layout_reads(s, d):
    path, r = new_path(s, "keyed"), v.plain_reads(s, d)
    r.select(F.concat("dedup_key", F.lit(" lane@"), read_line(F.col("qname"), F.col("flag"), F.col("rname"), F.col("pos"))).alias("value")).write.text(path)
    return sources.read_reads(s, path, "keyed")[0].select("dedup_key", "qname", "flag", "rname", "pos")


@query(f"WITH {KEYS} SELECT qname, dedup_key, CASE WHEN CAST(qname AS BIGINT) % 5 = 0 THEN 1 ELSE 0 END AS un1, 0 AS un2 FROM keys")
def keys_of_four_columns(s, d):
    path = new_path(s, "keys4")
    sinks.write_keys(v.keys4(s, d), path)
    return sources.read_keys(s, path, 4)


@query(f"""WITH {READS}, {PLAN}, a AS (SELECT r.rname, CAST(r.pos % p.parts + p.acc AS INTEGER) AS pid FROM reads r JOIN plan p ON r.rname = p.rname)
SELECT DISTINCT 'part-' || lpad(CAST(pid AS VARCHAR), 5, '0') AS part, CASE WHEN rname = '*' THEN 'unmapped' ELSE rname END AS rname FROM a""")
def manifest_read(s, d):
    path, r = new_path(s, "manifest"), v.plain_reads(s, d)
    sinks.write_manifest(partition.assign(r, partition.plan(profile.contig_counts(r), PARTITIONS)), path)
    return sources.read_manifest(s, path).select("part", F.explode("rnames").alias("rname"))


@query(f"WITH {CONTIGS} SELECT rname, CAST(length AS BIGINT) AS length FROM contigs")
def fai_read(s, d):
    path = new_path(s, "fai")
    v.contigs(s, d).where("idx > 0").select(F.concat_ws("\t", "rname", "length", F.lit("6"), F.lit("60")).alias("value")).write.text(path)
    return sources.read_fai(s, path)


@query(f"WITH {READS} SELECT rname, file, count(*) AS n FROM reads GROUP BY rname, file")
def contig_counts_read(s, d):
    path = new_path(s, "rname")
    sinks.write_contig_counts(v.reads(s, d), path)
    got = sources.read_contig_counts(s, f"{path}/*")
    return got.select("rname", F.regexp_extract("file", r"file=(\d+)/", 1).cast("int").alias("file"), "n")


@query(f"""WITH {CONTIGS}, k AS (SELECT r.*, c.idx * 1000000 + r.pos // 1000000 AS region_key FROM reads r JOIN contigs c ON r.rname = c.rname)
SELECT CAST(region_key % {REGION_PARTITIONS} AS INTEGER) AS pid, count(*) AS n_reads, CAST(0 AS BIGINT) AS n_unsorted, CAST(1 AS BIGINT) AS n_headers FROM k GROUP BY 1""")
def sorted_text_files(s, d):
    """The files of sorted reads that begin with a header: their reads, those out of order, and their header lines."""
    path, r = new_path(s, "sorted"), v.plain_reads(s, d)
    sinks.write_reads(partition.assign_regions(r, v.contigs(s, d), REGION_PARTITIONS, "fine"), path, REGION_PARTITIONS, ["@HD\tSO:coordinate"])
    lines = s.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"part-(\d+)", 1).cast("int").alias("pid"), F.posexplode(F.split("value", "\n")).alias("at", "line")).where("line <> ''")
    pos = F.when(F.col("line").startswith("@"), F.lit(-1)).otherwise(parse_read(F.col("line"))["pos"])
    order = Window.partitionBy("pid").orderBy("at")
    seen = lines.withColumn("pos", pos).withColumn("before", F.lag("pos").over(order))
    return seen.groupBy("pid").agg(F.count_if(F.col("pos") >= 0).alias("n_reads"), F.count_if(F.col("before") > F.col("pos")).alias("n_unsorted"), F.count_if(F.col("pos") < 0).alias("n_headers"))
