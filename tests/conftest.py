import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from check import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tiny(spark):
    """Six cells, five genes, two samples: an all-zero gene (g5) and cell (s2/c3), a name in both samples (c1)."""
    counts = spark.createDataFrame(
        [("s1", "c1", "g1", 4), ("s1", "c1", "g2", 6), ("s1", "c2", "g1", 10), ("s1", "c3", "g3", 5),
         ("s1", "c3", "g1", 5), ("s2", "c1", "g2", 8), ("s2", "c2", "g1", 1), ("s2", "c2", "g2", 1),
         ("s2", "c2", "g4", 2)], "sample string, cell_id string, gene string, cnt bigint")
    cells = spark.createDataFrame(
        [("s1", "c1", "A"), ("s1", "c2", "A"), ("s1", "c3", "B"), ("s2", "c1", "B"), ("s2", "c2", None),
         ("s2", "c3", "Z")], "sample string, cell_id string, label string")
    genes = spark.createDataFrame(
        [("g1", "MT-1"), ("g2", "RPS6"), ("g3", "MRPS9"), ("g4", "RPL3"), ("g5", "ACTB")], "gene string, gene_name string")
    return counts, cells, genes
