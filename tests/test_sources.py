"""Readers on files shaped like the real inputs."""

import gzip

from cytolake.sources import matrix as mx, tables


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_dense_csv_with_quotes_and_several_files(spark, tmp_path):
    for s, shift in (("A", 0), ("B", 1)):
        (tmp_path / s).mkdir()
        (tmp_path / s / "m.csv").write_text(
            f'"","c-1","c2","c3"\n"g1",0,{2 + shift},0\n"g,2",3,0,4.5\n"g3",0,0,0\n')
    got = rows(mx.read_dense(spark, f"{tmp_path}/*/m.csv"))
    assert got == [("A", "c-1", "g,2", 3.0), ("A", "c2", "g1", 2.0), ("A", "c3", "g,2", 4.5),
                   ("B", "c-1", "g,2", 3.0), ("B", "c2", "g1", 3.0), ("B", "c3", "g,2", 4.5)]


def test_dense_tsv_gz_short_header_dropped_column_and_names(spark, tmp_path):
    (tmp_path / "S").mkdir()
    with gzip.open(tmp_path / "S" / "m.tsv.gz", "wt") as f:
        f.write("Index\tx-1\tx-2\ng1\t7\t1\t0\ng2\t8\t0\t2\n")
    got = rows(mx.read_dense(spark, f"{tmp_path}/S/m.tsv.gz", sep="\t", drop=["Index"], corner=False, mangle_names=True))
    assert got == [("S", "x.1", "g1", 1.0), ("S", "x.2", "g2", 2.0)]


def test_dense_reader_searches_the_path_once_per_cell_name(spark, tmp_path):
    (tmp_path / "S").mkdir()
    (tmp_path / "S" / "m.csv").write_text('"",c1,"c2\n"g1","2",0\ng2,0,3"\n')
    found = mx.read_dense(spark, f"{tmp_path}/S/m.csv")
    searches = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "/[^/]+$" in x]
    assert searches and not any("cnt" in x for x in searches)          # not beside the values
    assert rows(found) == [("S", "c1", "g1", 2.0), ("S", "c2", "g2", 3.0)]


def test_triplet_folders(spark, tmp_path):
    for s in ("P1", "P2"):
        (tmp_path / s).mkdir()
        with gzip.open(tmp_path / s / "matrix.mtx.gz", "wt") as f:
            f.write("%%MatrixMarket matrix coordinate integer general\n%note\n3 2 3\n1 1 5\n3 1 1\n2 2 9\n")
        with gzip.open(tmp_path / s / "features.tsv.gz", "wt") as f:
            f.write("E1\tTLR3\tGene Expression\nE2\tIFIH1\tGene Expression\nE3\tDDX58\tGene Expression\n")
        with gzip.open(tmp_path / s / "barcodes.tsv.gz", "wt") as f:
            f.write(f"AAA-1\n{s}-1\n")
    got = rows(mx.read_triplet_folders(spark, str(tmp_path)))
    assert got == sorted((s, c, g, v) for s in ("P1", "P2") for c, g, v in
                         (("AAA-1", "TLR3", 5.0), ("AAA-1", "DDX58", 1.0), (f"{s}-1", "IFIH1", 9.0)))
    first = rows(mx.read_triplet_folders(spark, str(tmp_path), gene_column=1))
    assert {r[2] for r in first} == {"E1", "E2", "E3"}


def test_line_numbers_across_blocks(spark, tmp_path):
    (tmp_path / "S").mkdir()
    (tmp_path / "S" / "barcodes.tsv").write_text("".join(f"cell{i:05d}\n" for i in range(4000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 8192)
    try:
        got = mx._numbered_lines(spark, f"{tmp_path}/S/barcodes.tsv", mx.FOLDER).toPandas()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 4000 and (got.value == got.line.map(lambda n: f"cell{n - 1:05d}")).all()


def test_stage_and_discovery(spark, tmp_path, tiny):
    counts, _, _ = tiny
    tables.write_stage(counts, f"{tmp_path}/st", ["sample"])
    assert rows(tables.read_stage(spark, f"{tmp_path}/st").select(*counts.columns)) == rows(counts)
    found = tables.discover(spark, f"{tmp_path}/st/*/*.parquet", r"sample=([^/]+)/")
    assert {r["sample"] for r in found.collect()} == {"s1", "s2"}
