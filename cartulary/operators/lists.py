"""Lists that an application keeps: histories, recent files, projects, caps, cursors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartulary.functions.text import trimmed

#: The name of a project without one; a fixed value.
UNTITLED = "Untitled Project"


def most_recent(rows: DataFrame, key: Column, seq: str, cap: int, per: list[str] | None = None) -> DataFrame:
    """The last row of each key by seq, the most recent first, at most cap of them (for each of `per`); place from 1."""
    per = per or []
    last = rows.withColumn("__key", key).groupBy(*per, "__key").agg(F.max_by(F.struct(*rows.columns), seq).alias("r")).select("r.*")
    place = F.row_number().over(Window.partitionBy(*per).orderBy(F.col(seq).desc()))
    return last.withColumn("place", place).filter(F.col("place") <= cap)


def search_history(searches: DataFrame, cap: int = 10) -> DataFrame:
    """Terms of each user, trimmed, without blank ones, equal ones whatever their case once and in their last form. searches: user_id, seq, term."""
    clean = searches.withColumn("term", trimmed(F.col("term"))).filter("term <> ''")
    return most_recent(clean, F.lower("term"), "seq", cap, ["user_id"])


def recent_files(opened: DataFrame, cap: int = 20) -> DataFrame:
    """opened: user_id, seq, url."""
    return most_recent(opened, F.col("url"), "seq", cap, ["user_id"])


def dropped_files(paths: DataFrame, cap: int = 10) -> DataFrame:
    """The first `cap` different PDF paths, in their order. paths: ord, path."""
    kept = paths.filter(F.lower("path").endswith(".pdf")).withColumn("path", F.regexp_replace("path", "/+", "/"))
    return kept.groupBy("path").agg(F.min("ord").alias("ord")).orderBy("ord").limit(cap)


def restored(bookmarks: DataFrame, cap: int = 10) -> DataFrame:
    """Bookmarks (ord, resolved, path) to open again: resolved or by path, each URL once, the first `cap`; those by path alone are inaccessible."""
    found = bookmarks.withColumn("url", F.coalesce("resolved", "path")).filter("url is not null")
    return found.groupBy("url").agg(F.min("ord").alias("ord"), F.min_by(F.col("resolved").isNull(), "ord").alias("inaccessible")).orderBy("ord").limit(cap)


def toggled(toggles: DataFrame) -> DataFrame:
    """Pages with a bookmark after all toggles: those toggled an odd number of times."""
    return toggles.groupBy("doc_id", "page").agg(F.count("*").alias("n")).filter("n % 2 = 1").select("doc_id", "page")


def added_files(existing: DataFrame, added: DataFrame) -> DataFrame:
    """project_id, path, ord of all files after an addition: new ones first, each path once."""
    new = added.groupBy("project_id", "path").agg(F.min("ord").alias("ord")).join(existing.select("project_id", "path"), ["project_id", "path"], "left_anti").withColumn("old", F.lit(0))
    both = new.unionByName(existing.select("project_id", "path", "ord").withColumn("old", F.lit(1)))
    return both.withColumn("ord", F.row_number().over(Window.partitionBy("project_id").orderBy("old", "ord", "path")) - 1).drop("old")


def removed(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def removed_project(projects: DataFrame, files: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """projects (id) and their files (project_id) without some projects (id)."""
    return removed(projects, gone, "id"), files.join(gone.select(F.col("id").alias("project_id")), "project_id", "left_anti")


def closed_up(files: DataFrame, gone: DataFrame) -> DataFrame:
    """Recent files (user_id, ord, url, inaccessible, misses) without some (user_id, ord): those after them move up, with their flags."""
    rest = files.join(gone.select("user_id", "ord"), ["user_id", "ord"], "left_anti")
    return rest.withColumn("ord", (F.row_number().over(Window.partitionBy("user_id").orderBy("ord")) - 1).cast("int"))


def located(files: DataFrame, found: DataFrame) -> DataFrame:
    """Recent files with some (user_id, ord) replaced in place by a URL found for them: accessible, and with no misses counted. Places that no file has change nothing."""
    new = found.groupBy("user_id", "ord").agg(F.max("url").alias("new_url"))
    met = files.join(new, ["user_id", "ord"], "left")
    there = F.col("new_url").isNotNull()
    return met.withColumns({"url": F.coalesce("new_url", "url"), "inaccessible": F.when(there, False).otherwise(F.col("inaccessible")), "misses": F.when(there, 0).otherwise(F.col("misses")).cast("int")}).select(*files.columns)


def notices(shown: DataFrame, cap: int = 50) -> DataFrame:
    """The last `cap` notices of each user, the most recent first. shown: user_id, seq, title."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("seq").desc()))
    return shown.withColumn("place", place).filter(F.col("place") <= cap)


def reordered(rows: DataFrame, per: str, ident: str, moved: str, to: int) -> DataFrame:
    """rows with one of them moved to a place (as far as there is one), ord made anew."""
    own = Window.partitionBy(per).orderBy("ord", ident)
    placed = rows.withColumn("ord", F.row_number().over(own) - 1)
    here = placed.filter(F.col(ident) == moved).select(per, F.col("ord").alias("at"))
    size = placed.groupBy(per).agg(F.count("*").alias("n"))
    met = placed.join(here, per, "left").join(size, per)
    goal = F.greatest(F.lit(0), F.least(F.lit(to), F.col("n") - 1))
    shift = F.when(F.col("at").isNull(), F.col("ord")).when(F.col(ident) == moved, goal).when((F.col("ord") > F.col("at")) & (F.col("ord") <= goal), F.col("ord") - 1).when((F.col("ord") < F.col("at")) & (F.col("ord") >= goal), F.col("ord") + 1).otherwise(F.col("ord"))
    return met.withColumn("ord", shift.cast("int")).drop("at", "n")


def unique_names(names: DataFrame) -> DataFrame:
    """id, unique_name of names (id, name) added in order of id: trimmed; a taken one, case and accents aside, gets the first free of (2), (3) ...

    A blank name becomes UNTITLED, which may stand several times. Only names that are alike but for such suffixes can
    meet; where all of those are alike, their turn is their number, else they are added one by one.
    """
    folded = lambda c: F.expr(f"lower(translate({c}, 'ÀÁÂÃÄÅàáâãäåÈÉÊËèéêëÌÍÎÏìíîïÒÓÔÕÖòóôõöÙÚÛÜùúûüÇçÑñ', 'AAAAAAaaaaaaEEEEeeeeIIIIiiiiOOOOOoooooUUUUuuuuCcNn'))")
    clean = names.select("id", trimmed(F.coalesce("name", F.lit(""))).alias("name")).withColumn("fold", folded("name"))
    blank = clean.filter("name = ''").select("id", F.lit(UNTITLED).alias("unique_name"))
    rows = clean.filter("name <> ''").withColumn("family", F.regexp_replace("fold", r"( \(\d+\))+$", ""))
    mixed = rows.groupBy("family").agg((F.min("fold") != F.max("fold")).alias("mixed"))
    rows = rows.join(mixed, "family")
    turn = F.row_number().over(Window.partitionBy("fold").orderBy("id"))
    alike = rows.filter("not mixed").withColumn("turn", turn)
    alike = alike.select("id", F.when(F.col("turn") > 1, F.concat("name", F.lit(" ("), F.col("turn"), F.lit(")"))).otherwise(F.col("name")).alias("unique_name"))

    def one_by_one(family: pd.DataFrame) -> pd.DataFrame:
        taken, next_free, out = set(), {}, []
        for name, fold in family.sort_values("id")[["name", "fold"]].itertuples(index=False):
            k, suffix = next_free.get(fold, 1), ""
            while fold + suffix in taken:
                k += 1
                suffix = f" ({k})"
            next_free[fold] = k
            taken.add(fold + suffix)
            out.append(name + suffix)
        return pd.DataFrame({"id": family.sort_values("id")["id"], "unique_name": out})

    kind = names.schema["id"].dataType.simpleString()
    added = rows.filter("mixed").groupBy("family").applyInPandas(one_by_one, f"id {kind}, unique_name string")
    return alike.unionByName(added).unionByName(blank)


def cursor(results: DataFrame, at: int, step: int) -> DataFrame:
    """The result `step` places on from place `at`, round the end. results: ord."""
    placed = results.withColumn("place", F.row_number().over(Window.orderBy("ord")) - 1)
    n = results.agg(F.count("*").alias("n"))
    return placed.join(n).filter(F.col("place") == F.pmod(F.lit(at + step), F.col("n"))).drop("n")


def sorted_projects(projects: DataFrame, mode: str) -> DataFrame:
    order = {"manual": [F.col("ord")], "name": [F.lower("name")], "updated": [F.col("updated_at").desc()], "added": [F.col("added_at").desc()]}[mode]
    return projects.orderBy(*order, "id")


def expanded(nodes: DataFrame, state: str) -> DataFrame:
    return nodes.withColumn("expansion_state", F.lit(state))


def toggled_expansion(nodes: DataFrame, node: str) -> DataFrame:
    other = F.when(F.col("expansion_state") == "expanded", "collapsed").otherwise("expanded")
    return nodes.withColumn("expansion_state", F.when(F.col("node_id") == node, other).otherwise(F.col("expansion_state")))
