"""Writers and export records. Every writer takes ``write=False`` by default and then only returns what it would write."""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import number


def write_text_table(df: DataFrame, path: str, write: bool = False, mode: str = "overwrite") -> DataFrame:
    """CSV with a header and CRLF line ends; ``mode='append'`` serves audit tables."""
    if write:
        df.write.mode(mode).option("header", True).option("lineSep", "\r\n").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("escape", '"').option("emptyValue", "").csv(path)
    return df


def write_cells(cells: DataFrame, path: str, method: str, densifier: str, strategy: str, write: bool = False) -> DataFrame:
    """Completed cells as Parquet, partitioned so that one slice is read without the others."""
    out = cells.withColumns({"method": F.lit(method), "densifier": F.lit(densifier), "strategy": F.lit(strategy)})
    if write:
        out.write.mode("append").partitionBy("method", "densifier", "strategy").parquet(path)
    return out


def evaluation_id(model: Column, benchmark: Column, url: Column) -> Column:
    """md5 of the three parts joined by underscores; null counts as empty."""
    return F.md5(F.concat_ws("_", *[F.coalesce(c, F.lit("")) for c in (model, benchmark, url)]))


def export_records(results: DataFrame, benchmarks: DataFrame, timestamp: str) -> DataFrame:
    """(benchmark_id, record): the nested JSON record of each result. Empty parts are left out; the join is to the item list."""
    meta = benchmarks.select(F.lower("benchmark_id").alias("_b"), F.col("benchmark_name").alias("_name"), F.col("hf_url").alias("_hf"))
    j = results.withColumn("_b", F.lower("benchmark_id")).join(meta, "_b", "left")
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    repo = F.when(F.contains("_hf", F.lit("huggingface.co")), F.replace("_hf", F.lit("https://huggingface.co/datasets/"), F.lit("")))
    name = F.coalesce("_name", "benchmark_id")
    args = F.struct(number(F.col("generation_temperature")).alias("temperature"), number(F.col("generation_max_tokens")).cast("int").alias("max_tokens"), number(F.col("generation_top_p")).alias("top_p"))
    some = F.coalesce(*[given(c) for c in ("generation_temperature", "generation_max_tokens", "generation_top_p")]).isNotNull()
    engine = given("inference_engine")
    evaluation = F.struct(
        name.alias("evaluation_name"), F.lit(timestamp).alias("evaluation_timestamp"), F.struct(name.alias("dataset_name"), F.nullif(repo, F.lit("")).alias("hf_repo")).alias("source_data"),
        F.struct(F.coalesce(given("metric"), F.lit("Score")).alias("evaluation_description")).alias("metric_config"), F.struct(F.coalesce(number(F.col("score")), F.lit(0.0)).alias("score")).alias("score_details"),
        F.when(some, F.struct(args.alias("generation_args"))).alias("generation_config"),
    )
    record = F.struct(
        F.lit("0.2.1").alias("schema_version"), evaluation_id(F.col("model_name"), F.col("benchmark_id"), F.col("source_url")).alias("evaluation_id"), F.lit(timestamp).alias("retrieved_timestamp"),
        F.struct(F.coalesce(given("source_url"), F.lit("unknown")).alias("source_name"), F.lit("evaluation_run").alias("source_type")).alias("source_metadata"),
        F.struct(F.coalesce("model_name", F.lit("")).alias("name"), F.replace(F.lower(F.coalesce("model_name", F.lit(""))), F.lit(" "), F.lit("-")).alias("id"), F.coalesce(given("model_developer"), F.lit("unknown")).alias("developer"), given("inference_platform").alias("inference_platform"), F.when(engine.isNotNull(), F.struct(engine.alias("name"))).alias("inference_engine")).alias("model_info"),
        F.array(evaluation).alias("evaluation_results"),
    )
    return j.select("row_id", F.col("_b").alias("benchmark_id"), F.to_json(record).alias("record")) if "row_id" in results.columns else j.select(F.col("_b").alias("benchmark_id"), F.to_json(record).alias("record"))


def write_records(records: DataFrame, path: str, write: bool = False) -> DataFrame:
    """JSON lines, one folder per item."""
    if write:
        records.select("benchmark_id", F.col("record").alias("value")).write.mode("overwrite").partitionBy("benchmark_id").text(path)
    return records


def column_widths(df: DataFrame, ordinal: str, sample: int = 20, most: int = 60) -> DataFrame:
    """(column_name, width): the longest of the header and the first rows, plus 2, at most ``most``."""
    cols = [c for c in df.columns if c != ordinal]
    head = df.orderBy(ordinal).limit(sample)
    longest = head.agg(*[F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0)).alias(c) for c in cols])
    return longest.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.least(F.lit(most), F.greatest(F.lit(len(c)), F.col(c)) + 2).alias("width")) for c in cols])).alias("x")).select("x.*")


def write_workbook(tables: dict[str, DataFrame], path: str, rows: int = 1_048_575) -> dict[str, int]:
    """A workbook with one sheet per table and a frozen header, as inline strings. A sheet can't hold more than ``rows`` rows: larger
    tables are refused."""
    counts: dict[str, int] = {}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(tables)
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1)) + "</Types>")
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", '<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        cell = lambda v: f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' if v is not None else "<c/>"
        for i, (name, df) in enumerate(tables.items(), 1):
            n = df.count()
            if n > rows:
                raise ValueError(f"{name}: {n} rows are more than a sheet holds")
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as out:
                out.write(b'<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData>')
                out.write(("<row>" + "".join(map(cell, df.columns)) + "</row>").encode())
                for r in df.toLocalIterator():
                    out.write(("<row>" + "".join(map(cell, r)) + "</row>").encode())
                out.write(b"</sheetData></worksheet>")
            counts[name] = n
    return counts
