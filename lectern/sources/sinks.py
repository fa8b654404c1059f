"""Writers: several tables become visible at once, by one pointer."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def digest(rows: DataFrame) -> DataFrame:
    """Rows and an order-free digest of a table."""
    columns = sorted(rows.columns)
    return rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def write_jsonl(rows: DataFrame, path: str, force: bool = False) -> None:
    """JSON lines with sorted keys."""
    rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite" if force else "errorifexists").text(path)


def write_csv(rows: DataFrame, columns: list[str], path: str, force: bool = False) -> None:
    rows.select(*columns).write.mode("overwrite" if force else "errorifexists").option("header", True).option("lineSep", "\n").csv(path)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place, then rename it over what is there: readers see the old one or the new one."""
    part, fs = _path(spark, f"{path}.part-{uuid.uuid4().hex}")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    target, _ = _path(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    how = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    how[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(fs.makeQualified(target).toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(part), fs.makeQualified(target), how)


def _get(spark: SparkSession, path: str) -> str | None:
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


class Runs:
    """Runs of a stage under one folder: tables of a run in ``run=<id>``, and a pointer to the current one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def current(self) -> dict | None:
        text = _get(self.spark, f"{self.root}/CURRENT")
        return json.loads(text) if text else None

    def reusable(self, version: str, inputs: dict[str, str]) -> bool:
        """Whether the current run was made by this version from these inputs, and its tables are as they were."""
        run = self.current()
        return bool(run) and run["version"] == version and run["inputs"] == inputs and all(self._state(self.read(n)) == s for n, s in run["tables"].items())

    def _state(self, rows: DataFrame) -> dict:
        return digest(rows).first().asDict()

    def commit(self, tables: dict[str, DataFrame], version: str, inputs: dict[str, str] | None = None, force: bool = False) -> dict:
        """Write all tables, check them against what was read back, then move the pointer; on failure the old run stays."""
        if self.current() and not force:
            raise FileExistsError(f"{self.root} has a current run")
        run = uuid.uuid4().hex
        made = {}
        try:
            for name, rows in tables.items():
                at = f"{self.root}/run={run}/{name}"
                rows.write.parquet(at)
                made[name] = self._state(self.spark.read.parquet(at))
            _put(self.spark, f"{self.root}/CURRENT", json.dumps({"run": run, "version": version, "inputs": inputs or {}, "tables": made}, sort_keys=True))
        except Exception:
            p, fs = _path(self.spark, f"{self.root}/run={run}")
            fs.delete(p, True)
            raise
        return self.current()

    def read(self, name: str) -> DataFrame:
        run = self.current()
        if not run:
            raise FileNotFoundError(f"{self.root} has no current run")
        return self.spark.read.parquet(f"{self.root}/run={run['run']}/{name}")


def lineage_problems(run: dict, version: str, inputs: dict[str, str], totals: dict[str, int]) -> list[str]:
    """What a run's record says otherwise than expected."""
    out = [] if run["version"] == version else [f"version {run['version']} instead of {version}"]
    out += [f"input {k} has changed" for k, v in inputs.items() if run["inputs"].get(k) != v]
    return out + [f"{t}: {run['tables'].get(t, {}).get('rows')} rows instead of {n}" for t, n in totals.items() if run["tables"].get(t, {}).get("rows") != n]


def markdown_table(rows: DataFrame, n: int = 50) -> str:
    """First ``n`` rows of a small result as a Markdown table; a last line says so if there are more."""
    head = [f"| {' | '.join(rows.columns)} |", f"|{'---|' * len(rows.columns)}"]
    found = rows.limit(n + 1).collect()
    cells = lambda r: " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r)
    return "\n".join(head + [f"| {cells(r)} |" for r in found[:n]] + ([f"\nOnly the first {n} rows are shown."] if len(found) > n else []))


def markdown_report(title: str, parts: dict[str, DataFrame | str | dict], n: int = 50) -> str:
    """A report: sections with a table, some words, or figures by name."""
    out = [f"# {title}"]
    for name, part in parts.items():
        body = part if isinstance(part, str) else "\n".join(f"- {k}: {v}" for k, v in part.items()) if isinstance(part, dict) else markdown_table(part, n)
        out.append(f"## {name}\n\n{body}")
    return "\n\n".join(out) + "\n"


def write_manifest(rows: DataFrame, order: list[str], columns: list[str], path: str, force: bool = False) -> dict[str, int | str]:
    """A manifest as ``csv`` and ``jsonl`` under ``path``, each in order and in as few files as its ranges; gives rows and digest."""
    mode = "overwrite" if force else "errorifexists"
    placed = rows.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order)
    write_csv(placed, columns, f"{path}/csv", force)
    placed.select(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(f"{path}/jsonl")
    return digest(rows.select(*columns)).first().asDict()


def write_snapshot(spark: SparkSession, path: str, content: bytes, metadata: dict) -> str:
    """Fetched bytes under the digest of their content, with their metadata beside them; a snapshot that is there already is left alone."""
    sha = hashlib.sha256(content).hexdigest()
    at, fs = _path(spark, f"{path}/{sha}.bin")
    if not fs.exists(at):
        part, _ = _path(spark, f"{path}/{sha}.bin.part-{uuid.uuid4().hex}")
        stream = fs.create(part, True)
        try:
            stream.write(bytearray(content))
        finally:
            stream.close()
        fs.rename(part, at)
    _put(spark, f"{path}/{sha}.json", json.dumps(metadata | {"sha256": sha, "bytes": len(content)}, sort_keys=True))
    return sha


def write_weights(rows: DataFrame, key: str, weights: str, path: str) -> dict[str, int | str]:
    """Rows of a dense matrix with their identifier; a repeated one, or rows of unequal width, are an error."""
    own = rows.select(key, F.col(weights).cast("array<float>").alias("weights"))
    odd = own.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    widths = [r.w for r in own.select(F.size("weights").alias("w")).distinct().limit(2).collect()]
    if odd or len(widths) > 1:
        raise ValueError(f"identifier {odd[0][0]} is repeated" if odd else f"rows of widths {widths}")
    own.write.parquet(path)
    return digest(own).first().asDict()


def save_model(vocabulary: DataFrame, components: DataFrame, documents: int, path: str) -> None:
    """Terms with their place, frequency and weight, and each topic's weights by place: tables that any version can read."""
    place = F.row_number().over(W.orderBy("term")) - 1  # max_features rows
    words = vocabulary.select("term", "df").withColumn("idx", place.cast("long")).withColumn("idf", F.ln((1 + F.lit(float(documents))) / (1 + F.col("df"))) + 1)
    words.write.parquet(f"{path}/vocabulary")
    stored = vocabulary.sparkSession.read.parquet(f"{path}/vocabulary")
    known = components.join(stored, "term").select("topic", "idx", "weight")
    known.write.parquet(f"{path}/components")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vocabulary ``term, df, idx, idf`` and components ``topic, idx, weight``; places that the vocabulary lacks are an error."""
    words, weights = spark.read.parquet(f"{path}/vocabulary"), spark.read.parquet(f"{path}/components")
    if lost := weights.join(words, "idx", "left_anti").limit(1).collect():
        raise ValueError(f"no term has place {lost[0].idx}")
    return words, weights


def artifact_problems(run: dict, needed: list[str], checks: dict[str, bool], grid: list[dict], k: int, sizes: dict[str, tuple[int, int]]) -> list[str]:
    """What keeps a grid's run from being built upon: missing tables, checks that fail, a chosen ``k`` that is missing, repeated or not converged, and sizes that disagree."""
    out = [f"{n} is missing" for n in needed if n not in run.get("tables", {})] + [f"{n} doesn't hold" for n, ok in checks.items() if not ok]
    own = [g for g in grid if g["k"] == k]
    if len(own) != 1:
        out.append(f"k = {k} is there {len(own)} times")
    elif not own[0]["converged"]:
        out.append(f"k = {k} has not converged")
    return out + [f"{n}: {a} instead of {b}" for n, (a, b) in sizes.items() if a != b]
