"""Stored genealogies: a folder with a table each of nodes, edges, sites, mutations, migrations, individuals and populations.

``spark.read.format("genealogy").option("table", "edges").load(path)`` reads one
of them and ``df.write.format("genealogy").option("table", "edges")`` writes it,
once ``register`` has been called. A table is a set of blocks, Arrow files of at
most ``block_rows`` rows, and a manifest that lists them with the least and
greatest value of each number column. A block is a partition when it is read. Tasks
write under names of their own and only what the manifest lists belongs to the
table, so tasks that are lost or run twice leave no rows behind. The manifest grows with
the number of blocks and passes through the driver; rows don't.

Metadata are JSON texts. Overwriting deletes the blocks of the table before, so
it must not be one that the same job reads.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

# The tables of a genealogy and the columns each must have; more columns may stand beside them.
COLUMNS = {
    "nodes": ("id", "time", "population", "individual"),
    "edges": ("left", "right", "parent", "child"),
    "sites": ("id", "position", "ancestral_state"),
    "mutations": ("id", "site", "node", "parent", "derived_state"),
    "migrations": ("left", "right", "node", "source", "dest", "time"),
    "individuals": ("id", "metadata"),
    "populations": ("id", "metadata"),
}
VERSION = 1


def _place(path: str):
    """(file system, path in it) of a folder named by a path or an address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.rstrip("/")) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path.rstrip("/"))


def _manifest(folder: str) -> dict | None:
    files, at = _place(folder)
    from pyarrow import fs

    if files.get_file_info(f"{at}/manifest.json").type == fs.FileType.NotFound:
        return None
    with files.open_input_stream(f"{at}/manifest.json") as f:
        found = json.loads(f.read())
    if found.get("version") != VERSION:
        raise ValueError(f"{folder}: version {found.get('version')} of the format is not known")
    return found


@dataclass
class Written(WriterCommitMessage):
    blocks: list


@dataclass
class Block(InputPartition):
    file: str


class GenealogySource(DataSource):
    """One table of a stored genealogy; options ``path``, ``table`` and, for writing, ``block_rows``."""

    @classmethod
    def name(cls) -> str:
        return "genealogy"

    def _folder(self) -> str:
        table = self.options.get("table", "")
        if table not in COLUMNS:
            raise ValueError(f"option table is {table!r}, not one of {', '.join(COLUMNS)}")
        return f"{self.options['path'].rstrip('/')}/{table}"

    def schema(self) -> StructType:
        found = _manifest(self._folder())
        if found is None:
            raise ValueError(f"{self._folder()} holds no table")
        return StructType.fromJson(found["schema"])

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = SkippingReader if self.options.get("skip_blocks", "false").lower() == "true" else BlockReader
        return kind(self._folder())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        table = self.options.get("table", "")
        lost = [c for c in COLUMNS.get(table, ()) if c not in schema.names]
        if lost:
            raise ValueError(f"{table} lacks {', '.join(lost)}")
        return BlockWriter(self._folder(), schema, overwrite, int(self.options.get("block_rows", "1000000")))


class BlockReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.wanted = folder, []

    def partitions(self) -> list[Block]:
        blocks = (_manifest(self.folder) or {"blocks": []})["blocks"]
        kept = [Block(b["file"]) for b in blocks if all(may_match(b["bounds"].get(c), kind, v) for c, kind, v in self.wanted)]
        return kept or [Block("")]  # Spark asks for at least one

    def read(self, partition: Block):
        if partition.file:
            import pyarrow as pa

            files, at = _place(self.folder)
            with files.open_input_file(f"{at}/{partition.file}") as f:
                batches = pa.ipc.open_file(f)
                for k in range(batches.num_record_batches):
                    yield batches.get_batch(k)


class SkippingReader(BlockReader):
    """A reader that leaves out blocks whose bounds exclude every row asked for; Spark must allow it by ``spark.sql.python.filterPushdown.enabled``."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1:
                self.wanted.append((f.attribute[0], type(f).__name__, f.value))
            yield f  # rows are still tested by Spark


def may_match(bounds, kind: str, value) -> bool:
    """Whether a block with these bounds of a column may hold a row that compares so with ``value``; without bounds it may."""
    if not bounds or not isinstance(value, (int, float)):
        return True
    least, most = bounds
    return {"EqualTo": least <= value <= most, "GreaterThan": most > value, "GreaterThanOrEqual": most >= value, "LessThan": least < value, "LessThanOrEqual": least <= value}[kind]


class BlockWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, schema: StructType, overwrite: bool, block_rows: int):
        self.folder, self.schema, self.overwrite, self.block_rows = folder, schema.jsonValue(), overwrite, block_rows

    def write(self, iterator) -> Written:
        import pyarrow as pa

        files, at = _place(self.folder)
        files.create_dir(at, recursive=True)
        blocks, out, sink = [], None, None
        for batch in iterator:
            while batch.num_rows:
                if out is None:
                    blocks.append({"file": f"block-{uuid.uuid4().hex}.arrow", "rows": 0, "bounds": {}})
                    sink = files.open_output_stream(f"{at}/{blocks[-1]['file']}")
                    out = pa.ipc.new_file(sink, batch.schema)
                part = batch.slice(0, self.block_rows - blocks[-1]["rows"])
                out.write_batch(part)
                _widen(blocks[-1], part)
                batch = batch.slice(part.num_rows)
                if blocks[-1]["rows"] == self.block_rows:
                    out.close()
                    sink.close()
                    out = None
        if out is not None:
            out.close()
            sink.close()
        for b in blocks:
            b["bounds"] = {c: x for c, x in b["bounds"].items() if x}
        return Written(blocks)

    def commit(self, messages) -> None:
        before = _manifest(self.folder)
        blocks = [b for m in messages if m is not None for b in m.blocks]
        if before and not self.overwrite:
            kinds = lambda schema: [(f["name"], f["type"]) for f in schema["fields"]]
            if kinds(before["schema"]) != kinds(self.schema):
                self.abort(messages)
                raise ValueError(f"{self.folder} has other columns than the rows that were to be added")
            blocks = before["blocks"] + blocks
        files, at = _place(self.folder)
        files.create_dir(at, recursive=True)
        new = f"{at}/manifest-{uuid.uuid4().hex}"
        with files.open_output_stream(new) as f:
            f.write(json.dumps({"version": VERSION, "schema": self.schema, "rows": sum(b["rows"] for b in blocks), "blocks": blocks}).encode())
        files.move(new, f"{at}/manifest.json")
        if before and self.overwrite:
            for b in before["blocks"]:
                files.delete_file(f"{at}/{b['file']}")

    def abort(self, messages) -> None:
        files, at = _place(self.folder)
        for b in [b for m in messages if m is not None for b in m.blocks]:
            files.delete_file(f"{at}/{b['file']}")


def _widen(block: dict, batch) -> None:
    """Count a batch's rows in and widen the bounds of number columns by it; a column with NaN or null in it gets none."""
    import pyarrow as pa
    import pyarrow.compute as pc

    block["rows"] += batch.num_rows
    for name, column in zip(batch.schema.names, batch.columns):
        if not (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)):
            continue
        now = block["bounds"].get(name, ())
        if now is None or column.null_count or (pa.types.is_floating(column.type) and pc.any(pc.is_nan(column)).as_py()):
            block["bounds"][name] = None
            continue
        ends = pc.min_max(column).as_py()
        block["bounds"][name] = [min([ends["min"], *now[:1]]), max([ends["max"], *now[1:]])]


def register(spark: SparkSession) -> None:
    """Make the format ``genealogy`` known to a session."""
    spark.dataSource.register(GenealogySource)


def write_bundle(tables: dict[str, DataFrame], path: str, block_rows: int = 1_000_000) -> None:
    """Write tables by name into a folder that driver and executors share."""
    for table, df in tables.items():
        register(df.sparkSession)
        df.write.format("genealogy").option("table", table).option("block_rows", block_rows).mode("overwrite").save(path)


def read_bundle(spark: SparkSession, path: str, tables: tuple[str, ...] | None = None, check: bool = True) -> dict[str, DataFrame]:
    """The tables of a folder that are there, or those asked for. With ``check``, a bundle with ``faults`` is refused and the first ten are named."""
    register(spark)
    skip = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    there = tables or [t for t in COLUMNS if _manifest(f"{path.rstrip('/')}/{t}") is not None]
    found = {t: spark.read.format("genealogy").option("table", t).option("skip_blocks", skip).load(path) for t in there}
    if check:
        wrong = faults(found).limit(10).collect() if found else []
        if wrong:
            raise ValueError("; ".join(f"{w.table} {w.id}: {w.fault}" for w in wrong))
    return found


def faults(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, id, fault): references to rows that aren't there, repeated ids, spans and times out of order, metadata that are no JSON.

    Edges and migrations have their left end as id. References into tables that
    are not given are not followed; -1 and null refer to nothing where that is allowed.
    """
    out = []

    def add(table, rows, fault, row="id"):
        out.append(rows.select(F.lit(table).alias("table"), F.col(row).cast("string").alias("id"), F.lit(fault).alias("fault")))

    def refers(table, column, target, row="id", none=False):
        if table in tables and target in tables:
            rows = tables[table].where(f"{column} IS NOT NULL AND {column} <> -1") if none else tables[table]
            known = tables[target].select(F.col("id").alias(column))
            add(table, rows.join(known, column, "left_anti"), f"{column} is none of the {target}", row)

    for table in ("nodes", "sites", "mutations", "individuals", "populations"):
        if table in tables:
            add(table, tables[table].groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL"), "id is null or repeated")
    refers("nodes", "population", "populations", none=True)
    refers("nodes", "individual", "individuals", none=True)
    for column in ("parent", "child"):
        refers("edges", column, "nodes", "left")
    refers("mutations", "site", "sites")
    refers("mutations", "node", "nodes")
    for column in ("source", "dest"):
        refers("migrations", column, "populations", "left")
    refers("migrations", "node", "nodes", "left")
    for table in ("edges", "migrations"):
        if table in tables:
            add(table, tables[table].where("left < 0 OR left >= right OR isnan(left) OR isnan(right) OR left IS NULL OR right IS NULL"), "left is not below right, or below 0", "left")
    if "sites" in tables:
        add("sites", tables["sites"].where("position < 0 OR isnan(position) OR position IS NULL"), "position is not 0 or above")
    if {"edges", "nodes"} <= set(tables):
        times = lambda c: tables["nodes"].select(F.col("id").alias(c), F.col("time").alias(f"_{c}"))
        add("edges", tables["edges"].join(times("parent"), "parent").join(times("child"), "child").where("_parent <= _child"), "parent is not older than child", "left")
    if "mutations" in tables:
        above = tables["mutations"].select(F.col("id").alias("parent"), F.col("site").alias("_site"), F.lit(True).alias("_there"))
        met = tables["mutations"].where("parent <> -1").join(above, "parent", "left")
        add("mutations", met.where("_there IS NULL OR _site <> site"), "parent is no mutation of the same site")
    for table in ("individuals", "populations"):
        if table in tables:
            add(table, tables[table].where((F.length("metadata") > 0) & F.try_parse_json("metadata").isNull()), "metadata are no JSON")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def model_populations(populations: DataFrame, initial_size: float = 0.0, by: tuple[str, ...] = ()) -> DataFrame:
    """The populations of ``models`` with ``name`` and ``description`` as stored (id, metadata) have them: (model, ...), model 0 or the column ``by``.

    Sizes are not stored, so all have ``initial_size``. Where metadata are no JSON object or give no name, a population is ``pop_`` and its id.
    """
    there = F.ltrim("metadata").startswith("{")
    told = lambda what: F.when(there, F.get_json_object("metadata", f"$.{what}"))
    return populations.select(
        (F.col(by[0]) if by else F.lit(0)).cast("long").alias("model"), F.col("id").cast("int").alias("population"), F.lit(float(initial_size)).alias("initial_size"), F.lit(0.0).alias("growth_rate"),
        F.lit(None).cast("boolean").alias("initially_active"), F.coalesce(told("name"), F.concat(F.lit("pop_"), F.col("id").cast("string"))).alias("name"), F.coalesce(told("description"), F.lit("")).alias("description"),
    )


def stored_populations(populations: DataFrame) -> DataFrame:
    """(id, metadata) of a model's populations with ``name`` and, where there is one, ``description``: the inverse of ``model_populations``."""
    description = "description" if "description" in populations.columns else F.lit("").alias("description")
    return populations.select(F.col("population").cast("long").alias("id"), F.to_json(F.struct("name", description)).alias("metadata"))


def with_populations(stored: DataFrame, populations: DataFrame) -> DataFrame:
    """``stored`` (id, metadata) and the model's populations that it doesn't have yet."""
    return stored.select("id", "metadata").unionByName(stored_populations(populations).join(stored.select("id"), "id", "left_anti"))
