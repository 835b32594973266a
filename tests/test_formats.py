"""Text formats, by small files with their odd cases."""

from pyspark.sql import functions as F

from lodestar.functions import sam
from lodestar.functions.paths import clean_path
from lodestar.functions.timing import Timer
from lodestar.functions.vectors import gap, l2
from lodestar.operators import contigs
from lodestar.sources import text


def put(folder, name, *lines):
    (folder / name).write_text("\n".join(lines) + "\n")
    return str(folder / name)


def test_header(spark, tmp_path, rows):
    path = put(tmp_path, "Output0.samsbl", "@HD\tVN:1", "@SQ\tSN:chr2\tLN:9", "@SQ\tSN:chr10\tLN:8", "@SQ\tSN:chr2\tLN:9", "@RG\tID:a", "@RG\tID:b", "@PG\tID:x", "r1 0 chr2 5")
    header = text.read_header(spark, path)
    assert rows(contigs.dictionary_of_header(header), "rname", "idx") == [("*", 0), ("chr10", 2), ("chr2", 1)]
    assert [r["value"] for r in contigs.kept_header(header).orderBy("at").collect()] == ["@SQ\tSN:chr2\tLN:9", "@SQ\tSN:chr10\tLN:8", "@RG\tID:a"]


def test_sam_layout(spark, tmp_path):
    path = put(tmp_path, "Output1.sbl", "@SQ\tSN:chr2", "r1\t99\tchr2\t100\t60\t10M", "r2 147  *  x 60", "r3 0 chr2", "")
    good, bad = text.read_reads(spark, path)
    got = {r["qname"]: r for r in good.collect()}
    assert set(got) == {"r1", "r2"}
    assert (got["r1"]["flag"], got["r1"]["pos"], got["r1"]["others"]) == (99, 100, ["60", "10M"])
    assert (got["r2"]["rname"], got["r2"]["pos"]) == ("*", 987654321)
    assert [r["value"] for r in bad.collect()] == ["r3 0 chr2"]
    assert text.read_reads(spark, path, bad_pos=-1)[0].where("qname = 'r2'").first()["pos"] == -1


def test_keyed_layout(spark, tmp_path, rows):
    path = put(tmp_path, "Output2.sbl", "k1 a@b@r1 99 chr2 100 60", "k2 r2 0 chr2 x")
    good, _ = text.read_reads(spark, path, "keyed")
    assert rows(good, "dedup_key", "qname", "pos") == [("k1", "r1", 100), ("k2", "r2", 0)]


def test_debug_and_flags(spark):
    row = spark.createDataFrame([("a b", "r 1 c 5  x")], "s string, t string").select(
        sam.debug_line(F.col("s")), sam.debug_line(F.col("t")), sam.mark_duplicate(F.lit(99)), sam.mark_duplicate(F.lit(1123)), sam.mark_duplicate(F.lit(0)), sam.has_flag(F.lit(5), 4)
    ).first()
    assert tuple(row) == ("DBG less string: a b", "r\t1\tc\t5\tx", 1123, 1123, 1024, True)


def test_keys_counts_manifest_fai(spark, tmp_path, rows):
    two = put(tmp_path, "a.key", "r1\tk1", "r2\tk1")
    four = put(tmp_path, "b.key", "r1\tk1\t0\t1")
    assert rows(text.read_keys(spark, two)) == [("r1", "k1"), ("r2", "k1")]
    assert rows(text.read_keys(spark, four, 4)) == [("r1", "k1", 0, 1)]
    assert rows(text.read_keys(spark, two, 1)) == [("r1\tk1",), ("r2\tk1",)]
    assert rows(text.read_contig_counts(spark, put(tmp_path, "c.rname", "chr2\t5", "*\t1")), "rname", "n") == [("*", 1), ("chr2", 5)]
    manifest = text.read_manifest(spark, put(tmp_path, "part.info", "part-00000\tchr2", "", "part-00001\tchr2,chr1-0"))
    assert rows(manifest, "part", "rnames") == [("part-00000", ["chr2"]), ("part-00001", ["chr2", "chr1-0"])]
    assert rows(text.read_fai(spark, put(tmp_path, "ref.fa.fai", "a\t250\t1", "b 100 2"))) == [("a", 250), ("b", 100)]


def test_files_by_number(spark, tmp_path):
    for n in (2, 10, 0):
        put(tmp_path, f"Output{n}.sbl", f"r{n} 0 c 1")
    lines = text.read_lines(spark, f"{tmp_path}/*.sbl").withColumn("n", text.file_number(F.col("file")))
    got = [(r["n"], r["b"]) for r in lines.withColumn("b", text.batch_number(F.col("file"), 2)).orderBy("n").collect()]
    assert got == [(0, 0), (2, 1), (10, 5)]
    files = text.list_files(spark, str(tmp_path), "*.sbl")
    assert sorted(r["name"] for r in files.collect()) == ["Output0.sbl", "Output10.sbl", "Output2.sbl"]
    assert spark.range(1).select(text.merged_contig(F.lit("000001-chr-1.merged")), text.bam_contig(F.lit("chr-2.bam"))).first()[:] == ("chr-1", "chr-2")


def test_vectors(spark, tmp_path):
    path = put(tmp_path, "v.txt", " ".join(map(str, range(128))) + " lab", "")
    row = text.read_vectors(spark, path).first()
    assert row["features"] == list(range(128)) and row["label"] == "lab"
    assert text.read_query_vectors(spark, put(tmp_path, "q.txt", "1 2 3")).first()["features"] == [1, 2, 3]
    d = spark.range(1).select(l2(F.array(F.lit(0), F.lit(3)), F.array(F.lit(4), F.lit(0))), gap(F.lit(2), F.lit(5), F.lit(9)), gap(F.lit(2), F.lit(5), F.lit(3)))
    assert tuple(d.first()) == (5.0, 4, 0)


def test_small_helpers():
    assert clean_path("hdfs://h//a//b/") == "hdfs://h/a/b"
    assert clean_path("/") == "/"
    t = Timer()
    t.check("a")
    assert t.check("b") >= 0 and t.shown() == "0m 0s (0)s"
