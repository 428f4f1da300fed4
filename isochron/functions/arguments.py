"""Arguments of calls as VARIANT columns: dotted paths, comparisons that keep the types of JSON apart, resolved windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")


def _members(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _with(value: Column, made: Callable[[Column], Column]) -> Column:
    """``made`` of ``value``, which is computed once a row: an expression that is named twice in a lambda or a branch is computed twice."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def walk(doc: Column, path: Column | str) -> Column:
    """What a dotted path leads to: a struct of found (array<variant>) and lost (boolean).

    A segment is a key of an object or a place in a list, from its end if negative; ``*`` goes through all members of a list and collects what they
    have (those without it are passed over). lost: there is no such place, which is not the same as a JSON null there, or ``*`` met no list. A null ``doc`` has nothing.
    Paths may be columns; they are walked segment by segment, with no fixed depth.
    """
    none = F.expr("CAST(array() AS array<variant>)")
    path = F.lit(path) if isinstance(path, str) else path

    def one(v: Column, segment: Column) -> Column:
        def reached(of: Column) -> Column:
            members, items = of["members"], of["items"]
            place = segment.try_cast("int")
            item = F.try_element_at(items, F.when(place < 0, place).otherwise(place + 1))  # from 1, or from the end
            return F.when(members.isNotNull(), F.when(F.map_contains_key(members, segment), F.array(members[segment])).otherwise(none)).when(items.isNotNull() & item.isNotNull(), F.array(item)).otherwise(none)

        return _with(F.struct(_members(v).alias("members"), _items(v).alias("items")), reached)

    def step(state: Column, segment: Column) -> Column:
        def after(each: Column) -> Column:
            lists = F.forall(state["found"], lambda v: _items(v).isNotNull())
            star = state["star"] | (segment == "*")
            lost = state["lost"] | F.when(segment == "*", ~state["star"] & ~lists).otherwise(~state["star"] & (F.size(each) == 0))
            return F.struct(each.alias("found"), star.alias("star"), lost.alias("lost"))

        return _with(F.flatten(F.transform(state["found"], lambda v: F.when(segment == "*", F.coalesce(_items(v), none)).otherwise(one(v, segment)))), after)

    start = F.struct(F.when(doc.isNull(), none).otherwise(F.array(doc)).alias("found"), F.lit(False).alias("star"), doc.isNull().alias("lost"))
    return F.aggregate(F.split(path, r"\."), start, step)


def canonical(v: Column) -> Column:
    """A text that is the same for equal JSON values: 1 and 1.0 are, "1", true and 1 are not; null for no value at all, ``null`` for JSON's. Keys of objects are in order."""
    kind = F.substring_index(F.schema_of_variant(v), "(", 1)  # DECIMAL has digits behind it
    return F.when(kind.isin(*_NUMBERS), F.concat(F.lit("n"), F.try_variant_get(v, "$", "double").cast("string"))).otherwise(F.to_json(v))


def as_number(v: Column) -> Column:
    """A number, or a text that is one, as double; booleans are none."""
    kind = F.schema_of_variant(v)
    return F.when(kind == "BOOLEAN", None).otherwise(F.try_variant_get(v, "$", "double"))


def resolved_window(args: Column, today: Column) -> Column:
    """Struct of start and end of the window that an object of arguments asks for: from start_date and end_date (or start and end), or from past_days and forecast_days around ``today``.

    Absolute days and counts together, half a range, an end before the start and counts below one are no window: null. Without any of them: seven days from today. Texts that are no days count as absent ends.
    """
    text = lambda *names: F.coalesce(*(F.try_variant_get(args, f"$.{n}", "string") for n in names)).try_cast("date")
    start, end = text("start_date", "start"), text("end_date", "end")
    past, ahead = F.try_variant_get(args, "$.past_days", "int"), F.try_variant_get(args, "$.forecast_days", "int")
    counts = past.isNotNull() | ahead.isNotNull()
    days = F.when(counts, ahead).otherwise(F.lit(7))
    first = F.when(past.isNotNull(), F.date_sub(today, past)).otherwise(today)
    last = F.when(days.isNotNull(), F.date_add(today, days - 1)).otherwise(F.date_sub(today, F.lit(1)))
    wrong = (past < 1) | (ahead < 1)
    relative = F.when(start.isNull() & end.isNull() & ~F.coalesce(wrong, F.lit(False)), F.struct(first.alias("start"), last.alias("end")))
    absolute = F.when(start.isNotNull() & end.isNotNull() & ~counts & (start <= end), F.struct(start.alias("start"), end.alias("end")))
    return F.when(_members(args).isNotNull(), F.coalesce(absolute, relative))


def passed(rows: DataFrame) -> DataFrame:
    """``rows`` (args, path, op, value, low, high, resolve, today) with ok: whether the arguments (variant) pass the check. Never null.

    ``eq``: the value at ``path`` equals ``value``; ``set_eq``: as sets, a single value being a set of one; ``present``: there is one that is not null and, with ``low`` or ``high``, a number within them.
    With ``resolve`` the path ends in start, start_date, end or end_date, and the end of the resolved window of what it stands in is compared.
    A path with ``*`` gives a list. Unknown operators pass nothing.
    """
    path, op = F.col("path"), F.col("op")
    leaf = F.element_at(F.split(path, r"\."), -1)
    many = F.array_contains(F.split(path, r"\."), "*")
    texts = lambda items: F.transform(items, canonical)
    listed = lambda items: F.concat(F.lit("["), F.array_join(texts(items), ","), F.lit("]"))
    as_set = lambda items: F.array_sort(F.array_distinct(texts(items)))
    df = rows.withColumn("__walk", walk(F.col("args"), path)).withColumn("__many", many)
    df = df.withColumn("__found", F.col("__walk.found")).withColumn("__lost", F.col("__walk.lost")).withColumn("__single", F.get(F.col("__walk.found"), F.lit(0)))
    parent = F.when(path.contains("."), F.get(walk(F.col("args"), F.regexp_replace(path, r"\.[^.]*$", ""))["found"], F.lit(0))).otherwise(F.col("args"))
    df = df.withColumn("__window", F.when(F.col("resolve"), _with(parent, lambda of: resolved_window(of, F.col("today")))))
    many, found, lost, single, value = (F.col(c) for c in ("__many", "__found", "__lost", "__single", "value"))
    day = F.when(leaf.isin("start", "start_date"), F.col("__window.start")).when(leaf.isin("end", "end_date"), F.col("__window.end"))

    there = F.when(many, F.size(found) > 0).otherwise(~lost & ~F.coalesce(F.is_variant_null(single), F.lit(True)))
    number = as_number(single)
    bounded = F.col("low").isNotNull() | F.col("high").isNotNull()
    plausible = ~bounded | (number.isNotNull() & F.coalesce(number >= F.col("low"), F.lit(True)) & F.coalesce(number <= F.col("high"), F.lit(True)))
    mine = F.when(many, as_set(found)).otherwise(as_set(F.coalesce(_items(single), F.array(single))))
    same_set = mine == as_set(F.coalesce(_items(value), F.array(value)))
    same = F.when(many, listed(found) == listed(_items(value))).otherwise(canonical(single) == canonical(value))
    plain = F.when(op == "present", there & plausible).when(lost, False).when(op == "set_eq", same_set).when(op == "eq", same)
    of_window = F.when(op == "present", day.isNotNull()).when(op.isin("eq", "set_eq"), day.cast("string") == F.try_variant_get(value, "$", "string"))
    ok = F.coalesce(F.when(F.col("resolve"), of_window).otherwise(plain), F.lit(False))
    return df.withColumn("ok", ok).drop("__walk", "__many", "__found", "__lost", "__single", "__window")
