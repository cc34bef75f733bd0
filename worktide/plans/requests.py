"""Row validation: requests, visits, user updates, owner access."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktide import lexicon as lx
from worktide.functions import text as tx
from worktide.operators.computed import computed

FIELDS = "map<string,variant>"


def fields(body: Column) -> Column:
    """Top-level fields of a JSON object; null for anything else."""
    return F.from_json(body, FIELDS)


def _type(value: Column) -> Column:
    return F.schema_of_variant(value)


def _names(items: Sequence[str]) -> Column:
    return F.array(*[F.lit(i) for i in items])


def request_verdict(
    content_type: Column,
    doc: Column,
    allowed: Sequence[str] = lx.REQUEST_FIELDS,
    question_field: str = "pregunta",
    max_length: int = lx.QUESTION_MAX_LENGTH,
) -> Column:
    """First failed check of a question request, null when it passes.

    ``doc`` is a column of parsed :func:`fields`; parse in a step of its own, so
    that each document is read once.
    """
    optional = F.map_filter(doc, lambda k, v: (k != question_field) & (_type(v) != "STRING"))
    question = F.try_element_at(doc, F.lit(question_field))
    text = tx.trim_ws(F.try_variant_get(question, "$", "string"))
    is_text = F.coalesce(_type(question) == "STRING", F.lit(False))
    return (
        F.when(~F.lower(tx.text_or_empty(content_type)).contains("application/json"), "not_json")
        .when(doc.isNull(), "not_an_object")
        .when(F.size(F.array_except(F.map_keys(doc), _names(allowed))) > 0, "unexpected_field")
        .when(F.size(F.map_keys(optional)) > 0, "context_not_text")
        .when(~is_text, "question_not_text")
        .when(text == "", "question_empty")
        .when(F.length(text) > max_length, "question_too_long")
    )


def _counters_valid(actions: Column, counters: Sequence[str]) -> Column:
    def valid(inner: Column) -> Column:
        return (
            inner.isNotNull()
            & (F.size(F.array_except(F.map_keys(inner), _names(counters))) == 0)
            & (F.size(F.array_except(_names(counters), F.map_keys(inner))) == 0)
            & F.forall(F.map_values(inner), lambda v: _type(v).rlike("^(BIGINT|DOUBLE|DECIMAL.*)$"))
        )

    # Four conditions look at the counters; they are parsed once.
    return tx.let(fields(F.to_json(actions)), valid)


def visit_verdict(
    doc_id: Column,
    doc: Column,
    text_fields: Sequence[str] = lx.VISIT_TEXT_FIELDS,
    counters: Sequence[str] = lx.VISIT_COUNTERS,
) -> Column:
    """First failed check of an anonymous visit, null when it passes."""
    allowed = [*text_fields, "timestamp", "acciones"]

    def at(name: str) -> Column:
        return F.try_element_at(doc, F.lit(name))

    def is_text(name: str) -> Column:
        return F.coalesce(_type(at(name)) == "STRING", F.lit(False))

    all_text = is_text(text_fields[0])
    for name in text_fields[1:]:
        all_text = all_text & is_text(name)
    stamp = F.try_variant_get(at("timestamp"), "$", "string")
    return (
        F.when(doc.isNull(), "not_an_object")
        .when(F.size(F.array_except(F.map_keys(doc), _names(allowed))) > 0, "unexpected_field")
        .when(
            ~F.coalesce(
                F.try_variant_get(at("visit_id"), "$", "string") == doc_id, F.lit(False)
            ),
            "id_mismatch",
        )
        .when(~all_text, "field_not_text")
        .when(F.try_to_timestamp(stamp).isNull(), "bad_timestamp")
        .when(~_counters_valid(at("acciones"), counters), "bad_counters")
    )


def changed_fields(old: Column, new: Column) -> Column:
    """Names whose value differs between two field maps, added and removed ones included."""

    def entries(doc: Column) -> Column:
        return F.map_entries(F.transform_values(doc, lambda k, v: F.to_json(v)))

    def names(sides: Column) -> Column:
        before, after = sides["before"], sides["after"]
        differing = F.concat(F.array_except(before, after), F.array_except(after, before))
        return F.array_distinct(F.transform(differing, lambda e: e["key"]))

    # Both directions look at both sides; each value is written as JSON once.
    return tx.let(F.struct(entries(old).alias("before"), entries(new).alias("after")), names)


def visit_update_verdict(
    old: Column, new: Column, counters: Sequence[str] = lx.VISIT_COUNTERS
) -> Column:
    """Only the counters of a stored visit may change."""
    outside = F.array_except(changed_fields(old, new), F.array(F.lit("acciones")))
    actions = F.try_element_at(new, F.lit("acciones"))
    return F.when(F.size(outside) > 0, "immutable_field").when(
        ~_counters_valid(actions, counters), "bad_counters"
    )


def user_update_verdict(
    old: Column,
    new: Column,
    editable: Sequence[str] = lx.USER_EDITABLE,
    reserved: Sequence[str] = lx.USER_RESERVED,
    flag: str = "esHosteleria",
) -> Column:
    """Reserved columns stay, editable ones keep their type."""
    keys = F.map_keys(new)
    wrong = F.map_filter(
        new,
        lambda k, v: k.isin(*editable)
        & F.when(k == flag, _type(v) != "BOOLEAN").otherwise(_type(v) != "STRING"),
    )
    return (
        F.when(F.size(F.array_except(keys, _names([*editable, *reserved]))) > 0, "unexpected_field")
        .when(
            F.size(F.array_intersect(changed_fields(old, new), _names(reserved))) > 0,
            "reserved_field",
        )
        .when(F.size(F.map_keys(wrong)) > 0, "wrong_type")
    )


def user_create_verdict(new: Column, editable: Sequence[str] = lx.USER_EDITABLE) -> Column:
    """A new user row holds editable columns only."""
    return F.when(F.size(F.array_except(F.map_keys(new), _names(editable))) > 0, "unexpected_field")


def owned(rows: DataFrame, owner: str, caller: Column | str) -> DataFrame:
    """Rows of one caller; the filter reaches the scan."""
    return rows.where(F.col(owner) == (F.lit(caller) if isinstance(caller, str) else caller))


def split(rows: DataFrame, verdict: Column) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected rows with their reason for the quarantine table."""
    checked = computed(rows, {"reject_reason": verdict})
    return (
        checked.where("reject_reason is null").drop("reject_reason"),
        checked.where("reject_reason is not null"),
    )
