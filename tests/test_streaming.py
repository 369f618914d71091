import json

from sheaf.streaming import intake

SCHEMA = "file string, page int, info string"


def test_pages_are_kept_once(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def arrive(name, rows):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(dict(zip(("file", "page", "info"), r, strict=True))) for r in rows))

    def run(checkpoint):
        query = intake.keep(intake.arriving(spark, f"{tmp_path}/in", SCHEMA, 1), f"{tmp_path}/store", f"{tmp_path}/{checkpoint}")
        query.awaitTermination()
        return sorted((r["file"], r["page"], r["info"]) for r in spark.read.parquet(f"{tmp_path}/store").collect())

    arrive("1.json", [("a", 0, "x"), ("a", 1, "y"), (None, 2, "z")])
    assert run("c") == [("a", 0, "x"), ("a", 1, "y")]
    arrive("2.json", [("a", 1, "again"), ("b", 0, "w")])
    assert run("c") == [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "w")]
    assert run("other") == [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "w")]  # all once more, as after a lost checkpoint
