"""What users take away: PDF files, an archive of them, the table as a workbook, texts and the history."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.operators import archive
from sheaf.operators.pagestore import HISTORY_KEPT, history

# Headings and names of files.
HEADINGS = ("动物编号", "性别", "出生日期", "父亲编号", "母亲编号", "最新体重(kg)", "来源文件", "页码", "备注")
COLUMNS = ("animal_id", "sex", "birth", "sire", "dam", "weight", "source", "pages", "note")
SHEET, TEXTS = "动物档案", "_OCR原文汇总.txt"
WIDTHS = (14, 6, 12, 12, 12, 12, 40, 12, 18)
HISTORY_PAGES = 8


def text_view(debug: Column) -> Column:
    """The texts of a document's pages, one under the other."""
    return F.array_join(F.coalesce(debug, F.array().cast("array<string>")), "\n", "")


def display_names(outputs: DataFrame, order: str = "place") -> DataFrame:
    """outputs with file_name: shown names, numbered from their second occurrence on, in the order shown."""
    name = F.coalesce(F.nullif(F.col("custom_name"), F.lit("")), F.col("new_name")) if "custom_name" in outputs.columns else F.col("new_name")
    k = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return outputs.withColumn("file_name", F.when(k > 1, F.concat_ws("_", name, k.cast("string"))).otherwise(name))


def archive_table(outputs: DataFrame) -> DataFrame:
    """The nine columns of the archive table, one row for each output that is a subject's, with `place`."""
    subjects = outputs.filter(F.col("id").isNotNull() & (F.col("id") != "") & ~F.col("id").rlike("^(?i:No[.])"))
    extra = F.col("extra_note") if "extra_note" in outputs.columns else F.lit(None).cast("string")
    merged = F.when(F.col("n") > 1, F.col("n")) if "n" in outputs.columns else F.lit(None).cast("int")
    row = archive.archive_row(
        F.col("debug"), F.col("id"), F.col("source"), F.col("page_range"),
        lambda f: archive.note(f, F.col("guessed"), F.col("corrected"), F.col("off_roster"), merged, extra),
    )
    return subjects.select("place", row.alias("r")).select("place", "r.*")


def write_pdfs(outputs: DataFrame, folder: str) -> int:
    """One PDF file for each output (file_name, content), by the tasks; the folder is one that all of them see."""

    def run(rows: Iterator) -> None:
        for r in rows:
            (Path(folder) / f"{r.file_name}.pdf").write_bytes(bytes(r.content))

    Path(folder).mkdir(parents=True, exist_ok=True)
    outputs.select("file_name", "content").foreachPartition(run)
    return outputs.count()


def write_zip(outputs: DataFrame, path: str) -> int:
    """A ZIP of the outputs (place, file_name, content, debug) in the order shown, with a file of all texts; the number of outputs.

    The driver takes rows partition by partition, as a ZIP is one file. Without outputs nothing is written.
    """
    rows = outputs.orderBy("place").select("file_name", "content", text_view(F.col("debug")).alias("text")).toLocalIterator()
    n, texts = 0, Path(f"{path}.txt")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z, texts.open("w", encoding="utf-8") as every:
        for n, r in enumerate(rows, 1):  # noqa: B007
            z.writestr(f"{r.file_name}.pdf", bytes(r.content or b""))
            every.write(("\n\n" if n > 1 else "") + f"===== {r.file_name} =====\n{r.text}")
        every.flush()
        z.write(texts, TEXTS)
    texts.unlink()
    if not n:
        Path(path).unlink()
    return n


def _cell(value: str, column: int, row: int) -> str:
    return f'<c r="{chr(65 + column)}{row}" t="inlineStr"><is><t xml:space="preserve">{escape("".join(c for c in value if c >= " " or c in "\t\n"))}</t></is></c>'


def write_workbook(table: DataFrame, path: str) -> int:
    """The archive table as a workbook of one sheet, rows in the order of place; the number of rows. Without rows nothing is written."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="{SHEET}" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w") as sheet:
            columns = "".join(f'<col min="{k}" max="{k}" width="{w}" customWidth="1"/>' for k, w in enumerate(WIDTHS, 1))
            sheet.write(f'{head}<worksheet xmlns="{main}"><cols>{columns}</cols><sheetData>'.encode())
            for k, values in enumerate([HEADINGS], 1):
                sheet.write(f'<row r="{k}">{"".join(_cell(v, c, k) for c, v in enumerate(values))}</row>'.encode())
            for n, r in enumerate(table.orderBy("place").select(*COLUMNS).toLocalIterator(), 1):  # noqa: B007
                sheet.write(f'<row r="{n + 1}">{"".join(_cell(v or "", c, n + 1) for c, v in enumerate(r))}</row>'.encode())
            sheet.write(b"</sheetData></worksheet>")
    if not n:
        Path(path).unlink()
    return n


def save_history(entries: DataFrame, folder: str) -> None:
    """The newest entries (time, renamed, debug and others) as JSON lines, each with the texts of a few pages."""
    newest = history(entries, "time", "renamed", HISTORY_KEPT)
    newest.withColumn("debug", F.slice("debug", 1, HISTORY_PAGES)).coalesce(1).write.mode("overwrite").json(folder)  # HISTORY_KEPT rows


def load_history(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The saved entries; none if nothing was saved. Lines that can't be read have nulls in all columns and are left out."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder)
