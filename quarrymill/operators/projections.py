"""Nested tracker records to flat structs: users, named values, states, options, comments, attachments, issues, fields, projects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import browse_url, truncated
from .evidence import flat_user

#: The columns of a search where the caller names none.
DEFAULT_FIELDS = ["key", "summary", "status", "issuetype", "assignee", "reporter", "priority", "created", "updated", "duedate", "labels"]


def select_fields(rows: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """The named columns, or the default ones; of these, those that are there, in the order asked for."""
    return rows.select(*[f for f in fields or DEFAULT_FIELDS if f in rows.columns])


def picked(value: Column, **fields: str) -> Column:
    """A struct of a nested value's fields by their new names; null for null."""
    return F.when(value.isNotNull(), F.struct(*[value[old].alias(new) for new, old in fields.items()]))


def named(value: Column) -> Column:
    return picked(value, id="id", name="name", description="description")


def status(value: Column) -> Column:
    """id, name, and the name of the category."""
    return F.when(value.isNotNull(), F.struct(value["id"].alias("id"), value["name"].alias("name"), value["statusCategory"]["name"].alias("category")))


def option(value: Column, depth: int = 1) -> Column:
    """id and value of an option, and its child as an option of one level less."""
    fields = [value["id"].alias("id"), value["value"].alias("value")]
    if depth:
        fields.append(option(value["child"], depth - 1).alias("child"))
    return F.when(value.isNotNull(), F.struct(*fields))


def comment(value: Column, most: int = 2000) -> Column:
    return F.when(
        value.isNotNull(),
        F.struct(value["id"].alias("id"), flat_user(value["author"]).alias("author"), value["created"].alias("created"), truncated(value["body"], most, "…[{n}]").alias("body")),
    )


def attachment(value: Column) -> Column:
    plain = {"id": "id", "filename": "filename", "size": "size", "mime_type": "mimeType", "created": "created", "content_url": "content"}
    return F.when(value.isNotNull(), F.struct(*[value[old].alias(new) for new, old in plain.items()], flat_user(value["author"]).alias("author")))


def field_meta(value: Column) -> Column:
    """id of a field by the first of three names that holds one, name, required, type by the schema's or its own."""
    ident = F.coalesce(*[F.nullif(value[k], F.lit("")) for k in ("fieldId", "key", "id")])
    kind = F.coalesce(F.nullif(value["schema"]["type"], F.lit("")), value["type"])
    required = F.coalesce(value["required"], F.lit(False))
    return F.struct(ident.alias("id"), value["name"].alias("name"), required.alias("required"), kind.alias("type"), value["schema"]["custom"].alias("custom"))


def project(value: Column) -> Column:
    return F.when(value.isNotNull(), F.struct(value["key"].alias("key"), value["id"].alias("id"), value["name"].alias("name"), flat_user(value["lead"]).alias("lead")))


def short_issue(key: Column, fields: Column, base: str, most: int = 200) -> list[Column]:
    """A search result's row."""
    return [
        key.alias("key"), browse_url(base, F.coalesce(key, F.lit(""))).alias("url"), truncated(fields["summary"], most).alias("summary"), status(fields["status"]).alias("status"),
        named(fields["issuetype"]).alias("issuetype"), flat_user(fields["assignee"]).alias("assignee"), flat_user(fields["reporter"]).alias("reporter"),
        fields["created"].alias("created"), F.coalesce(fields["labels"], F.array().cast("array<string>")).alias("labels"),
    ]


def full_issue(key: Column, fields: Column, base: str, comment_limit: int = 20, body_limit: int = 2000) -> list[Column]:
    """short_issue with the whole summary, components and the first comments, their total and whether some were left out.

    body_limit: characters of a comment's body; what is beyond gives way to a mark with the whole length.
    """
    held = F.coalesce(fields["comment"]["comments"], F.array())
    total = F.coalesce(fields["comment"]["total"], F.nullif(F.size(held), F.lit(0)))
    shown = F.transform(F.slice(held, 1, max(comment_limit, 0)), lambda c: comment(c, body_limit))
    short = [c for c in short_issue(key, fields, base)]
    return [
        *short[:2], fields["summary"].alias("summary"), *short[3:],
        F.transform(F.coalesce(fields["components"], F.array()), named).alias("components"), total.alias("comment_total"), shown.alias("comments"),
        F.coalesce((total > F.size(shown)) & F.lit(comment_limit > 0), F.lit(False)).alias("comments_truncated"),
    ]


def label_plan(before: Column, add: Column, remove: Column) -> list[Column]:
    """Labels that a change would really add and remove, each in order: what is there isn't added, what isn't there isn't removed."""
    have = F.coalesce(before, F.array().cast("array<string>"))
    empty = F.array().cast("array<string>")
    return [
        F.array_sort(F.array_except(F.coalesce(add, empty), have)).alias("added"),
        F.array_sort(F.array_intersect(F.coalesce(remove, empty), F.array_except(have, F.coalesce(add, empty)))).alias("removed"),
    ]


def planned_creates(wanted: DataFrame, existing: DataFrame, key: str, required: list[str]) -> DataFrame:
    """wanted with action: create, skip (there already) or refuse (a required field is blank)."""
    blank = reduce(lambda a, b: a | b, [F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) == "" for f in required])
    there = existing.select(key).distinct().withColumn("__there", F.lit(True))
    return wanted.join(there, key, "left").withColumn("action", F.when(F.col("__there"), "skip").when(blank, "refuse").otherwise("create")).drop("__there")
