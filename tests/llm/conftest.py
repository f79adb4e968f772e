import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("ckpt")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{folder}")
        .config("spark.sql.warehouse.dir", f"{folder}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def docs(spark, sf):
    """[(doc_id, text)] of the smallest documents table."""
    return [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


HARD_TEXTS = [None, "", " \t\n", "one", "word " * 3000, "naïve café — 漢字 " * 40, "dup line\n" * 30, "same text here " * 20, "same text here " * 20, "x" * 5000, "a\x00b" * 100, "\n\n\n"]


@pytest.fixture(scope="session")
def hard(spark):
    """Null, empty, blank, long, repeated and odd texts, a null id, repeated ids and rows, clashing extra columns."""
    rows = [(i, t, "x", 1.5) for i, t in enumerate(HARD_TEXTS)] + [(3, "one", "x", 1.5), (None, "no id", None, None), (7, "another text of the same id", "y", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, _id string, _row double")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
