"""The roster of a file, that is its list of identifiers in order, and what it corrects on the pages.

A roster belongs to one file and is bounded by what one page lists; rows of different files never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions import text as T

LEAST = 5


def build_roster(candidates: DataFrame) -> DataFrame:
    """file, roster from candidates (file, page, seq, id): the largest set of distinct identifiers of one shape on a page.

    Sets with letters go before sets of digits; the first of equal ones wins; sets of fewer than LEAST aren't rosters.
    """
    shaped = candidates.select("file", "page", "seq", F.upper("id").alias("id")).withColumn("shape", T.shape_key(F.col("id")))
    first = shaped.filter("shape is not null").groupBy("file", "page", "shape", "id").agg(F.min("seq").alias("seq"))
    groups = first.groupBy("file", "page", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"), F.array_sort(F.collect_list(F.struct("seq", "id"))).alias("ids")
    )
    groups = groups.filter(F.col("n") >= LEAST)
    rank = F.struct(~F.startswith(F.col("shape"), F.lit("#")), "n", -F.col("page"), -F.col("first"))
    best = groups.groupBy("file").agg(F.max_by("ids", rank).alias("ids"))
    return best.select("file", F.transform("ids", lambda x: x["id"]).alias("roster"))


def external_roster(rosters: DataFrame, files: DataFrame, pasted: str | None) -> DataFrame:
    """rosters (file, roster), replaced for all files by a pasted list, in upper case and of any size, if it names any."""
    given = files.select("file").distinct().withColumn("roster", F.array_distinct(F.transform(T.roster_text(F.lit(pasted)), F.upper)))
    whole = given.join(rosters.select(F.col("file").alias("_f"), F.col("roster").alias("_r")), F.col("file").eqNullSafe(F.col("_f")), "left")
    return whole.select("file", F.coalesce("roster", "_r").alias("roster")).filter("roster is not null")


def expanded(roster: Column, proved: Column) -> Column:
    """The roster with further identifiers that have the shape of its first one."""
    shape = T.shape_key(F.get(roster, 0))
    more = F.filter(F.transform(proved, F.upper), lambda v: T.shape_key(v) == shape)
    return F.array_union(roster, more)


def hits(roster: Column, candidates: Column) -> Column:
    """The candidates that the roster lists, distinct."""
    return F.array_intersect(F.array_distinct(F.transform(candidates, F.upper)), roster)


def fuzzy_match(identifier: Column, roster: Column, most: Column) -> Column:
    """The entry that an identifier means: itself without letters at its end, or the only one within `most` edits."""
    up = F.upper(identifier)
    letters = F.length(F.regexp_extract(up, "[A-Z]*$", 0))
    shorter = F.transform(
        F.sequence(F.lit(0), F.least(letters, F.greatest(F.length(up) - 3, F.lit(0)))), lambda k: F.substr(up, F.lit(1), F.length(up) - k)
    )
    member = F.get(F.filter(shorter, lambda v: F.array_contains(roster, v)), 0)
    near = F.filter(roster, lambda r: (F.abs(F.length(r) - F.length(up)) <= most) & (F.levenshtein(r, up) <= most))
    return F.coalesce(member, F.when(F.size(near) == 1, F.get(near, 0)))


def allowed_edits(identifier: Column) -> Column:
    """Neighbours in a dense series of numbers are other subjects: one edit for digits only, else two."""
    return F.when(identifier.rlike("^[0-9]+$"), 1).otherwise(2)


def _less(v: Column) -> Column:
    """A text without each of its characters in turn."""
    return F.transform(F.sequence(F.lit(0), F.length(v) - 1), lambda i: F.concat(F.substr(v, F.lit(1), i), F.substr(v, i + 2)))


def _hidden(v: Column) -> Column:
    """A text with each of its characters in turn hidden."""
    each = F.transform(F.sequence(F.lit(0), F.length(v) - 1), lambda i: F.concat(F.substr(v, F.lit(1), i), F.lit("\0"), F.substr(v, i + 2)))
    return F.when(F.length(v) > 0, each).otherwise(F.array(v))


def _keys(v: Column, longer: Column, most: Column) -> Column:
    """What a text has in common with all those within `most` edits that are shorter by `longer`, and with no others.

    Two edits between texts of one length change two characters or move one; else the longer one loses its surplus, and
    what edits are left change characters.
    """
    twice = lambda f, g: F.flatten(F.transform(f(v), g))
    moved = F.when(F.length(v) > 0, _less(v)).otherwise(F.array().cast("array<string>"))
    two = F.when(longer == 0, F.concat(twice(_hidden, _hidden), moved)).when(longer == 1, twice(_less, _hidden)).when(longer == -1, _hidden(v)).when(longer == 2, twice(_less, _less))
    one = F.when(longer == 0, _hidden(v)).when(longer == 1, _less(v))
    return F.array_distinct(F.coalesce(F.when(most == 2, two).otherwise(one), F.array(v)))


def meant(ids: DataFrame, entries: DataFrame) -> DataFrame:
    """file, id, match: fuzzy_match of distinct identifiers (file, id), with their allowed_edits, in rosters of any size (file, entry).

    Texts meet at keys that hold only for pairs within the edits, so of each key's entries two are enough to tell whether
    there is one: the work is in proportion to identifiers and entries, not to their pairs.
    """
    ids = ids.select("file", "id").distinct().filter("id is not null").withColumns({"up": F.upper("id"), "most": allowed_edits(F.col("id"))})
    letters = F.length(F.regexp_extract("up", "[A-Z]*$", 0))
    cuts = F.sequence(F.lit(0), F.least(letters, F.greatest(F.length("up") - 3, F.lit(0))))
    shorter = ids.select("file", "id", "up", F.explode(cuts).alias("k")).withColumn("entry", F.substr(F.col("up"), F.lit(1), F.length("up") - F.col("k")))
    member = shorter.join(entries.select("file", "entry"), ["file", "entry"]).groupBy("file", "id").agg(F.min_by("entry", "k").alias("member"))
    ids, entries = (x.withColumn("n", F.length(c)) for x, c in ((ids, "up"), (entries.select("file", "entry"), "entry")))
    sizes = ids.select("file", "most", F.col("n").alias("n_id")).distinct()
    sizes = sizes.join(entries.select("file", F.col("n").alias("n_entry")).distinct(), "file").filter(F.abs(F.col("n_id") - F.col("n_entry")) <= F.col("most"))
    gap, on = F.col("n_id") - F.col("n_entry"), ["file", "most", "n_id", "n_entry", "key"]
    left = ids.withColumnRenamed("n", "n_id").join(F.broadcast(sizes), ["file", "most", "n_id"])
    left = left.withColumn("key", F.explode(_keys(F.col("up"), gap, F.col("most"))))
    right = entries.withColumnRenamed("n", "n_entry").join(F.broadcast(sizes), ["file", "n_entry"])
    right = right.withColumn("key", F.explode(_keys(F.col("entry"), -gap, F.col("most"))))
    right = right.groupBy(*on).agg(F.min("entry").alias("low"), F.max("entry").alias("high"))
    near = left.join(right, on).groupBy("file", "id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    both = member.join(near, ["file", "id"], "full")
    return both.select("file", "id", F.coalesce("member", F.when(F.col("low") == F.col("high"), F.col("low"))).alias("match")).filter("match is not null")


def impute(pages: DataFrame) -> DataFrame:
    """pages (file, page, archive, id, labelled, roster) with `imputed`: identifiers by a page's place in the roster.

    Archive pages whose identifiers the roster lists are anchors. If there are three at least and all have one distance
    between their place among the archive pages and that in the roster, the others take the entry at theirs. Pages that
    the roster or a label names are left alone.
    """
    rows = _entry_due(pages.withColumn("listed", F.array_position("roster", F.upper("id")) - 1))
    return rows.withColumn("imputed", F.get("roster", F.col("at"))).drop("listed", "at")


def _entry_due(pages: DataFrame) -> DataFrame:
    """pages (file, page, archive, id, labelled, listed: the place of id in the roster) with `at`: the place of the entry that a page takes."""
    of_file = Window.partitionBy("file")
    place = F.row_number().over(Window.partitionBy("file", "archive").orderBy("page")) - 1
    rows = pages.withColumn("place", F.when(F.col("archive"), place)).withColumn("listed", F.when(F.col("listed") >= 0, F.col("listed")))
    offset = F.when(F.col("archive") & F.col("listed").isNotNull(), F.col("place") - F.col("listed"))
    rows = rows.withColumns({"offset": offset}).withColumns({
        "anchors": F.count("offset").over(of_file), "low": F.min("offset").over(of_file), "high": F.max("offset").over(of_file),
    })
    open_ = F.col("archive") & F.col("listed").isNull() & ~(F.col("id").isNotNull() & F.col("labelled"))
    at = F.col("place") - F.col("low")
    fits = open_ & (F.col("anchors") >= 3) & (F.col("low") == F.col("high")) & (at >= 0)
    return rows.withColumn("at", F.when(fits, at.cast("int"))).drop("place", "offset", "anchors", "low", "high")


def correct(pages: DataFrame, rosters: DataFrame) -> DataFrame:
    """Pages with identifiers held against their file's roster, in the columns id, corrected, off_roster, roster_page, guessed.

    pages: file, page, title, id, source (label, filename, pool or fallback), evidence, alts, candidates. A page that
    lists three entries belongs to no subject. Identifiers that the roster doesn't list are corrected to the entry that
    they mean, or to the only candidate that it lists; else those of weak sources are dropped and labelled ones marked.
    Entries are rows, which pages look up; no page carries its roster.
    """
    label = F.col("source") == "label"
    none = F.array().cast("array<string>")
    entries = rosters.select("file", F.posexplode("roster").alias("pos", "entry")).groupBy("file", "entry").agg(F.min("pos").alias("pos"))
    files = rosters.select("file", T.shape_key(F.get("roster", F.lit(0))).alias("_shape"), F.lit(True).alias("_known"))
    own = F.when(label & (F.col("evidence") >= 2), F.array("id")).otherwise(none)
    proved = pages.select("file", F.explode(F.array_union(own, F.coalesce("alts", none))).alias("v")).select("file", F.upper("v").alias("entry")).distinct()
    proved = proved.join(files, "file").filter(T.shape_key(F.col("entry")) == F.col("_shape")).select("file", "entry")
    listed = entries.select("file", "entry").union(proved).distinct()

    def among(rows: DataFrame, c: Column, name: str) -> DataFrame:
        """rows with whether their file lists an identifier."""
        found = listed.select(F.col("file").alias("_f"), F.col("entry").alias("_e"), F.lit(True).alias(name))
        return rows.join(found, (F.col("file") == F.col("_f")) & (c == F.col("_e")), "left").drop("_f", "_e").withColumn(name, F.coalesce(name, F.lit(False)))

    offered = pages.select("file", "candidates").filter(F.size("candidates") > 0).distinct()
    met = offered.select("file", "candidates", F.posexplode(F.array_distinct(F.transform("candidates", F.upper))).alias("_k", "entry")).join(listed, ["file", "entry"])
    met = met.groupBy(F.col("file").alias("_f"), F.col("candidates").alias("_c")).agg(F.array_sort(F.collect_list(F.struct("_k", "entry"))).alias("hits"))
    rows = pages.join(files.drop("_shape"), "file", "left").join(met, (F.col("file") == F.col("_f")) & (F.col("candidates") == F.col("_c")), "left").drop("_f", "_c")
    rows = rows.withColumn("hits", F.coalesce(F.transform("hits", lambda x: x["entry"]), none))
    rows = rows.withColumn("roster_page", F.size("hits") >= 3)
    rows = rows.withColumn("id", F.when(~F.col("roster_page"), F.col("id")))
    document = F.coalesce(F.col("id").rlike("^(?i:No[.])"), F.lit(False))
    rows = rows.withColumns({"document": document, "bare": F.regexp_replace("id", "^(?i:No[.])", "")})
    rows = among(among(rows, F.upper("id"), "_as_is"), F.upper("bare"), "_inside")
    rows = rows.withColumn("open", F.col("_known").isNotNull() & F.col("id").isNotNull() & ~F.col("_as_is") & ~F.col("_inside"))
    fixed = meant(rows.filter("open").select("file", F.col("bare").alias("id")), entries)
    fixed = fixed.select(F.col("file").alias("_f"), F.col("id").alias("_b"), "match")
    rows = rows.join(fixed, F.col("open") & (F.col("file") == F.col("_f")) & (F.col("bare") == F.col("_b")), "left").drop("_f", "_b")
    cross = F.array_intersect("hits", F.transform(F.coalesce("alts", none), F.upper))
    picked = F.when(F.size("hits") == 1, F.get("hits", F.lit(0))).when(F.size(cross) == 1, F.get(cross, 0))
    rows = rows.withColumn("better", F.when(F.col("open"), F.coalesce("match", F.when(~F.col("document"), picked))))
    weak = F.col("open") & F.col("better").isNull() & ~F.col("document")
    rows = rows.withColumns({
        "corrected": F.col("better").isNotNull(),
        "off_roster": F.coalesce(weak & label & (F.col("evidence") >= 1), F.lit(False)),
        "id": F.when(weak & F.col("source").isin("pool", "fallback"), None).otherwise(F.coalesce("better", "id")),
        "archive": F.coalesce(F.contains(F.col("title"), F.lit("档案")), F.lit(False)),
    })
    rows = among(rows, F.upper("id"), "_named").withColumn("labelled", F.coalesce(label, F.lit(False)) | F.col("_named"))
    places = entries.select(F.col("file").alias("_f"), F.col("entry").alias("_e"), F.col("pos").alias("listed"))
    rows = _entry_due(rows.join(places, (F.col("file") == F.col("_f")) & (F.upper("id") == F.col("_e")), "left").drop("_f", "_e"))
    taken = entries.select(F.col("file").alias("_f"), F.col("pos").alias("_p"), F.col("entry").alias("imputed"))
    rows = rows.join(taken, (F.col("file") == F.col("_f")) & (F.col("at") == F.col("_p")), "left")
    return rows.withColumns({"guessed": F.col("imputed").isNotNull(), "id": F.coalesce("imputed", "id")}).drop(
        "_f", "_p", "_known", "_as_is", "_inside", "_named", "hits", "document", "bare", "open", "match", "better", "archive", "labelled", "listed", "at", "imputed"
    )
