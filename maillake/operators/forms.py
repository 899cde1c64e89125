"""Form-letter requests and mail merge.

SURVEY P11, P12, F11, P19-P22, P28, W11.  The request body is exploded to
lines with their position; the key/value search, the "last line wins" rule
(``max_by(value, pos)``) and the pivot onto the kept columns are one
aggregate per (request, key), combined map-side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maillake.functions.text import (first_email, form_key, form_matches, form_value,
                                     render_map, template_fields)
from maillake.plans.sequential import global_row_number


def form_pairs(df: DataFrame, id_col: str, body: str, part: str | None = None) -> DataFrame:
    """(id, pos, key, value) for every line that carries a non-empty field.

    ``pos`` orders lines across parts (part, line) so later parts and later
    lines overwrite earlier ones; an ``email`` value is reduced to the first
    address in it (NULL if none, which makes the request an error).
    """
    part_col = F.col(part) if part else F.lit(0)
    lines = df.select(F.col(id_col), part_col.alias("_part"),
                      F.posexplode(F.split(F.col(body), "\n", -1)).alias("_line_no", "_line"))
    kv = (lines.filter(form_matches(F.col("_line")))
          .select(id_col, F.struct("_part", "_line_no").alias("pos"),
                  form_key(F.col("_line")).alias("key"), form_value(F.col("_line")).alias("value"))
          .filter(F.col("value") != ""))
    return kv.withColumn("value", F.when(F.col("key") == "email", first_email(F.col("value")))
                         .otherwise(F.col("value")))


def form_fields(df: DataFrame, id_col: str, body: str, keep: Sequence[str],
                part: str | None = None) -> DataFrame:
    """P11 + F11: one row per request with the kept fields and ``status`` ok / error.

    A request is usable when it has both ``email`` and ``name`` and no ``Email`` line
    without an address in it, whatever other lines hold.
    """
    pairs = form_pairs(df, id_col, body, part)
    last = pairs.groupBy(id_col, "key").agg(
        F.max_by("value", "pos").alias("value"), F.bool_or(F.col("value").isNull()).alias("bad"))
    wanted = sorted(set(keep) | {"email", "name"})
    wide = last.groupBy(id_col).agg(F.bool_or("bad").alias("_bad"), *[
        F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in wanted])
    allreq = df.select(id_col).distinct()
    out = allreq.join(wide, id_col, "left")
    ok = F.col("email").isNotNull() & F.col("name").isNotNull() & ~F.coalesce("_bad", F.lit(False))
    return out.select(id_col, *[F.col(k) for k in wanted],
                      F.when(ok, F.lit("ok")).otherwise(F.lit("error")).alias("status"))


def form_variables(fields: DataFrame, keys: Sequence[str], extra: Mapping[str, Column]) -> Column:
    """MAP of the request variables plus fixed addresses (from/sender/cc)."""
    entries = []
    for k in keys:
        entries += [F.lit(k), F.col(k)]
    for k, v in extra.items():
        entries += [F.lit(k), v]
    return F.create_map(*entries)


def reply_render(fields: DataFrame, id_col: str, template: str, keys: Sequence[str],
                 from_address: str, cc_address: str) -> DataFrame:
    """Reply text for each usable request: every ``%key%`` replaced by its value;
    ``%from_address%`` and ``%sender_address%`` by the responder address, ``%cc_address%``
    by the copy address."""
    ok = fields.filter(F.col("status") == "ok")
    extra = {"from_address": F.lit(from_address), "sender_address": F.lit(from_address),
             "cc_address": F.lit(cc_address)}
    vars_ = form_variables(ok, keys, extra)
    return ok.select(id_col, render_map(F.lit(template), vars_).alias("reply"))


def check_template(template: str, available: Sequence[str], defaults: Mapping[str, str]) -> list[str]:
    """P19/P20 plan-time check: fields of the template (first per line) all resolvable."""
    import re
    fields = sorted({m.group(1) for line in template.split("\n")
                     for m in [re.search(r"%([a-zA-Z]+)%", line)] if m})
    missing = [f for f in fields if f not in available and f not in defaults]
    if missing:
        raise ValueError(f"template fields without a column or default: {missing}")
    return fields


def mail_merge(addressees: DataFrame, template: str, defaults: Mapping[str, str] | None = None,
               id_col: str = "id") -> DataFrame:
    """P20: one rendered message per addressee row.

    Only the template's fields (first ``%name%`` of each line) are replaced,
    every occurrence of each; the value comes from the row's column of that
    name, else from ``defaults`` (configuration); a field with neither is an
    error before any row is processed.
    """
    defaults = dict(defaults or {})
    fields = check_template(template, addressees.columns, defaults)
    body = F.lit(template)
    for f in fields:
        v = F.col(f) if f in addressees.columns else F.lit(defaults[f])
        body = F.replace(body, F.lit(f"%{f}%"), F.coalesce(v, F.lit("")))
    return addressees.select(id_col, body.alias("body"))


def template_field_list(templates: DataFrame, col: str = "template") -> DataFrame:
    """P19 as a column: sorted distinct field names per template row."""
    return templates.withColumn("fields", template_fields(F.col(col)))


def send_schedule(df: DataFrame, order: Sequence[str], start: str, delay_seconds: int = 45
                  ) -> DataFrame:
    """The n-th message (in ``order``) is sent at start + delay * (n - 1)."""
    numbered = global_row_number(df, list(order), name="n")
    at = (F.to_timestamp_ntz(F.lit(start))
          + F.make_dt_interval(secs=(F.col("n") - 1) * F.lit(delay_seconds)))
    return numbered.withColumn("send_at", at)
