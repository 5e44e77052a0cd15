"""Fuzzy joins without comparing everything: similar names by prefix filter, connected groups, duplicate accounts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermend.operators import similarity
from ledgermend.workspace import discard, stored


def grams(name: Column, width: int) -> Column:
    """The runs of ``width`` letters of a text as a set: equal ones are numbered."""
    listed = F.when(F.length(name) >= width, F.array_sort(F.transform(F.sequence(F.lit(1), F.length(name) - (width - 1)), lambda k: F.substr(name, k, F.lit(width))))).otherwise(F.array().cast("array<string>"))
    return F.transform(listed, lambda g, k: F.concat(g, F.lit("#"), (k + 2 - F.array_position(listed, g)).cast("string")))


def similar_names(names: DataFrame, keys: Sequence[str], name: str, at_least: float = 0.8) -> DataFrame:
    """``keys, a, b, ratio``: pairs of different names of one key, ``a < b``, that are ``at_least`` similar by matching blocks.

    No pair is lost.  Two names of L letters together have at most ``(1 - t) L`` letters outside matching blocks, so at
    most one block more than that, and share at least ``(3/2 t - 1) L - 1`` pairs of neighbouring letters; the shorter has at
    least ``t / (2 - t)`` of the longer's letters.  So it is enough that names meet on one of so many of their rarest pairs;
    names too short for that meet on letters.  The pairs left are counted before blocks are matched.
    """
    if not 2 / 3 < at_least <= 1:
        raise ValueError("the filter needs a similarity above 2/3")
    keys, t = list(keys), at_least
    least = (1.5 * t - 1) * 2 / (2 - t)
    short = math.floor((1 + 1e-9) / least)  # up to here no shared pair is certain
    each = names.select(*keys, F.col(name).alias("name")).where(F.length("name") > 0).distinct()
    size = F.length("name")
    each = each.withColumn("grams", grams(F.col("name"), 2))
    asked = size - F.greatest(F.ceil(size * least - 1 - 1e-9), F.lit(0))
    pairs = each.where(size > short).select(*keys, "name", "grams", F.explode("grams").alias("token"), asked.alias("asked"))
    letters = each.where(size <= short * (2 - t) / t)
    letters = letters.select(*keys, "name", "grams", F.explode(grams(F.col("name"), 1)).alias("token"), (size + 1 - F.ceil(size * t / (2 - t) - 1e-9)).alias("asked"))
    tokens = stored(pairs.unionByName(letters), "name-tokens")
    often = tokens.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    rarest = Window.partitionBy(*keys, "name", F.length("token") - F.length(F.regexp_extract("token", r"#\d+$", 0))).orderBy(F.coalesce("often", F.lit(1)), "token")
    prefix = tokens.join(often, [*keys, "token"], "left").withColumn("place", F.row_number().over(rarest)).where("place <= asked and often is not null")
    left, right = (prefix.select(*keys, "token", F.col("name").alias(c), F.col("grams").alias(f"{c}_grams")) for c in ("a", "b"))
    la, lb = F.length("a"), F.length("b")
    met = left.join(right, [*keys, "token"]).where((F.col("a") < F.col("b")) & (F.least(la, lb) >= F.greatest(la, lb) * (t / (2 - t)) - 1e-9))
    shared = F.size(F.array_intersect("a_grams", "b_grams"))
    met = met.where(shared >= (la + lb) * (1.5 * t - 1) - 1 - 1e-9).select(*keys, "a", "b").distinct()
    met = stored(met.withColumn("_pair", F.sha2(F.concat_ws("\0", *[F.col(k).cast("string") for k in keys], "a", "b"), 256)), "name-pairs")
    discard(tokens)
    return similarity.ratio(met, "_pair", "a", "b").where(F.col("ratio") >= at_least - 1e-12).select(*keys, "a", "b", "ratio")


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: of every node with a link the least node that links reach.

    A round takes the least label of a node's neighbours and then that label's own, which is the least that any node of the label has seen: rounds
    grow with the logarithm of a path's length, in whatever order its nodes stand.
    Labels are one row a node and aggregate before they are shuffled.  Nodes of one label meet where its own label is read, a row each.
    """
    both = stored(links.select(F.col(a).alias("node"), F.col(b).alias("other")).union(links.select(b, a)).distinct(), "links")
    labels = stored(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")), "labels")
    moving = True
    while moving:
        around = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("seen"))
        lowered = labels.join(around, "node").select("node", F.col("component").alias("was"), F.least("component", "seen").alias("component"))
        own = lowered.select(F.col("node").alias("component"), F.col("component").alias("further")).union(lowered.select("was", "component").where("component < was"))
        own = own.groupBy("component").agg(F.min("further").alias("further"))
        step = stored(lowered.join(own, "component", "left").select("node", "was", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        moving = not step.where("component < was").isEmpty()
        discard(labels)
        labels = step
    discard(both)
    return labels.select("node", "component")


#: Words of a status that tell of trouble.
NEGATIVE = "chargeoff|charge-off|charge off|collection|repos|delinquent|late payments"
MAX_DAYS = 90


def distinct_accounts(accounts: DataFrame, session: str) -> DataFrame:
    """Accounts that agree in name, last four digits, bureaus, status and dates as one, with the categories of all.

    ``accounts`` has the session, id, name, account_number, bureaus, status, opened, closed, balance, category.  The row of the least id gives the
    account; names and statuses are compared in lower case, null as empty.
    """
    digits = F.regexp_replace(F.coalesce("account_number", F.lit("")), r"\D", "")
    same = accounts.withColumns({
        "_name": F.lower(F.coalesce("name", F.lit(""))), "_last": F.right(digits, F.lit(4)), "_status": F.lower(F.trim(F.coalesce("status", F.lit("")))),
        "_bureaus": F.array_sort(F.coalesce("bureaus", F.array().cast("array<string>"))),
    })
    kept = [c for c in accounts.columns if c not in (session, "category")]
    return same.groupBy(session, "_name", "_last", "_bureaus", "_status", "opened", "closed").agg(F.min_by(F.struct(*kept), "id").alias("_row"), F.sort_array(F.collect_set("category")).alias("categories")).select(session, "_row.*", "categories", "_name", "_last")


def _balance_cell(balance: Column) -> Column:
    """Balances of one cell don't differ too much for suspects, and those that don't are two cells apart at most; this needs cells a little narrower than what may differ."""
    inside = F.greatest(F.least(balance, F.lit(1e300)), F.lit(-1e12))
    cell = F.when(inside < 1000, F.floor(inside / 99)).otherwise(11 + F.floor(F.log(inside / 1000) / math.log(1.0999)))
    return F.when(balance.isNotNull(), cell)


def _day_cell(day: Column) -> Column:
    """So many days that all of them fit each other; fitting days are one cell apart at most."""
    return F.floor(F.date_diff(day, F.lit("1970-01-01").cast("date")) / (MAX_DAYS + 1))


def _asks(cell: Column, reach: int) -> Column:
    """What a row joins on so that it meets, once each, those of ``_offers`` whose cell is so near or missing; a missing cell meets all."""
    near = F.array(*[(cell + k).cast("string") for k in range(-reach, reach + 1)], F.lit("none"))
    return F.explode(F.when(cell.isNull(), F.array(F.lit("all"))).otherwise(near))


def _offers(cell: Column) -> Column:
    return F.explode(F.array(F.coalesce(cell.cast("string"), F.lit("none")), F.lit("all")))


def suspect_links(accounts: DataFrame, alike: DataFrame, session: str) -> DataFrame:
    """``a, b``: links between ids that join the same accounts as all pairs of suspects would, without making these pairs.

    ``accounts`` has the session, id, _name, _last, balance, opened, closed; ``alike`` the session and names a, b that may be suspects, both ways, each name with itself.
    Accounts of one name, number and cell of balance and dates are all suspects of each other: they link to the least id of their cell.  Cells
    link if accounts of theirs do: dates are compared day by day, and of balances in different cells the nearest two decide.  Equal
    numbers meet by number; the missing ones, of which a name has no more than cells and days, meet the cells near theirs.
    """
    # What isn't finite (or below all cells) need not fit its like.
    odd = F.when(~((F.col("balance") > -1e12) & (F.col("balance") < 1e300)), F.col("id"))
    each = accounts.select(session, "id", F.col("_name").alias("name"), F.col("_last").alias("last"), F.col("balance").cast("double"), "opened", "closed")
    each = each.withColumns({"step": _balance_cell(F.col("balance")), "era": _day_cell(F.col("opened")), "end": _day_cell(F.col("closed")), "_odd": odd})
    each = stored(each.withColumn("cell", F.min("id").over(Window.partitionBy(session, "name", "last", "step", "era", "end", "_odd"))), "cells")
    nodes = each.groupBy(session, "name", "last", "cell", "step", "era", "opened", "closed").agg(F.min("balance").alias("low"), F.max("balance").alias("high"))
    alike = stored(alike, "alike")
    value = F.struct("cell", "last", "step", "opened", "closed", "low", "high")
    left = alike.join(nodes.withColumnRenamed("name", "a"), [session, "a"]).select(session, "b", "last", "step", "era", value.alias("_a"))
    right = nodes.select(session, F.col("name").alias("b"), "last", "step", "era", value.alias("_b"))
    x, y = F.col("_a"), F.col("_b")
    below = x["step"] <= y["step"]
    bal_a, bal_b = F.when(below, x["high"]).otherwise(x["low"]), F.when(below, y["low"]).otherwise(y["high"])
    fits = (x["cell"] != y["cell"]) & F.coalesce(F.abs(bal_a - bal_b) <= F.greatest(F.lit(100.0), 0.1 * F.least(bal_a, bal_b)), F.lit(True))
    for field in ("opened", "closed"):
        fits = fits & F.coalesce(F.abs(F.date_diff(x[field], y[field])) <= MAX_DAYS, F.lit(True))
    same = left.where("last <> ''").join(right.where("last <> ''").drop("step", "era"), [session, "b", "last"])
    asking = left.where("last = ''").select(session, "b", "_a", "era", _asks(F.col("step"), 2).alias("_step")).withColumn("_era", _asks(F.col("era"), 1)).drop("era")
    offering = right.select(session, "b", "_b", "era", _offers(F.col("step")).alias("_step")).withColumn("_era", _offers(F.col("era"))).drop("era")
    missing = asking.join(offering, [session, "b", "_step", "_era"])
    found = same.where(fits).select("_a.cell", "_b.cell").union(missing.where(fits).select("_a.cell", "_b.cell")).toDF("a", "b")
    found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return found.union(each.where("id <> cell").select("cell", "id"))


def duplicate_suspects(accounts: DataFrame, session: str) -> DataFrame:
    """``distinct_accounts`` with ``duplicate_suspect`` and ``suspect_group``, the least id of a group of suspects (null for others).

    Two negative accounts of a session are suspects if their names are equal, one begins with the other or they are 0.8 similar, their last digits
    don't differ (a missing one differs from none), their balances by no more than 100 or a tenth of the lower, and their dates by no more than 90 days.
    """
    each = stored(distinct_accounts(accounts, session), "accounts")
    negative = each.where(F.array_contains("categories", "negative_accounts") | F.coalesce(F.lower("status").rlike(NEGATIVE), F.lit(False)))
    names = negative.select(session, F.col("_name").alias("name")).distinct()
    similar = similar_names(names, [session], "name").select(session, "a", "b")
    starts = names.select(session, F.col("name").alias("b"), F.explode(F.transform(F.sequence(F.lit(0), F.length("name")), lambda k: F.substr(F.col("name"), F.lit(1), k))).alias("a"))
    begun = starts.join(names.select(session, F.col("name").alias("a")), [session, "a"]).select(session, "a", "b")
    alike = similar.union(similar.select(session, F.col("b").alias("a"), F.col("a").alias("b"))).union(begun).union(begun.select(session, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    groups = connected(suspect_links(negative, alike, session))
    marked = each.join(groups.select(F.col("node").alias("id"), F.col("component").alias("suspect_group")), "id", "left")
    return marked.withColumn("duplicate_suspect", F.col("suspect_group").isNotNull()).drop("_name", "_last")


def merged_inquiries(parsed: DataFrame, found: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Inquiries of two readers as one list: ``keys, name, origin`` (parser or model), ``confirmed``.

    A parsed inquiry is confirmed by the other reader's most similar name of the same keys (ties: the first by text), 0.8 at least; several that one name
    confirms are one, the first by text.  The other reader's names that confirm none are kept.  Missing keys (null) agree with each other.
    """
    keys = list(keys)
    tag = F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(k) for k in keys])), 256)
    ours, theirs = (df.select(*keys, F.coalesce(name, F.lit("")).alias("name")).distinct().withColumn("_tag", tag) for df in (parsed, found))
    every = ours.select("_tag", "name").union(theirs.select("_tag", "name"))
    alike = similar_names(every, ["_tag"], "name")
    alike = alike.union(alike.select("_tag", F.col("b").alias("a"), F.col("a").alias("b"), "ratio")).union(every.distinct().select("_tag", F.col("name").alias("a"), F.col("name").alias("b"), F.lit(1.0).alias("ratio")))
    choice = alike.join(theirs.select("_tag", F.col("name").alias("b")), ["_tag", "b"]).groupBy("_tag", F.col("a").alias("name")).agg(F.min(F.struct((-F.col("ratio")).alias("r"), "b")).alias("x"))
    matched = ours.join(choice, ["_tag", "name"], "left").withColumn("match", F.col("x.b"))
    one = Window.partitionBy("_tag", F.coalesce("match", "name")).orderBy(F.col("match").isNull(), "name")
    mine = matched.withColumn("_n", F.row_number().over(one)).where("_n = 1")
    taken = mine.select("_tag", F.coalesce("match", "name").alias("name"))
    rest = theirs.join(taken, ["_tag", "name"], "left_anti")
    return mine.select(*keys, "name", F.lit("parser").alias("origin"), F.col("match").isNotNull().alias("confirmed")).union(rest.select(*keys, "name", F.lit("model"), F.lit(True)))
