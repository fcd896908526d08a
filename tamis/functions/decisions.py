"""Decision expressions: familiarity, routing with reasons, review queue rules, display rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPOT_CHECK_RATE = 0.1


def _col(x: Column | float | None) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def is_familiar(distance: Column, cutoff: Column | float, local: Column | None = None,
                local_cutoff: Column | float | None = None) -> Column:
    """Within the cutoff, or (when both are known) the nearest human-labelled row within the second cutoff."""
    near = F.coalesce(distance <= _col(cutoff), F.lit(False))
    if local is None or local_cutoff is None:
        return near
    return near | F.coalesce(local <= _col(local_cutoff), F.lit(False))


def familiar_by(distance: Column, cutoff: Column | float, familiar: Column) -> Column:
    return (F.when(distance.isNull() | ~familiar, F.lit(None).cast("string"))
            .when(distance <= _col(cutoff), "stored_rows").otherwise("reviewed_row"))


def route_reason(confident: Column, familiar: Column, routed: Column) -> Column:
    """Why a row goes to a person; null when it is answered. A routed class is named before the other causes."""
    return (F.when(routed, "other_problem").when(~familiar, "unfamiliar").when(~confident, "low_confidence"))


def route_reason_exclusive(confident: Column, familiar: Column, routed: Column) -> Column:
    """The second split of reasons: unfamiliar first, a routed class only when the row is confident and familiar."""
    return (F.when(~familiar, "unfamiliar").when(~confident, "low_confidence").when(routed, "other"))


def answered(confident: Column, familiar: Column, routed: Column) -> Column:
    return confident & familiar & ~routed


def confidence_band(p: Column, threshold: Column | float, not_sure: Column, high: Column | float | None = None) -> Column:
    t = _col(threshold)
    cut = _col(high) if high is not None else t + (F.lit(1.0) - t) / 2
    return F.when(not_sure, F.lit(None).cast("string")).when(p >= cut, "high").otherwise("medium")


def final_label(human: Column, not_sure: Column, disputed: Column, label: Column) -> Column:
    """A human label wins unless it is 'skip'; an unsure or disputed row has none; else the automatic label."""
    return (F.when(human.isNotNull() & (human != "skip"), human)
            .when(F.coalesce(not_sure, F.lit(False)) | F.coalesce(disputed, F.lit(False)), F.lit(None).cast("string"))
            .otherwise(label))


def in_queue(not_sure: Column, spot_check: Column, disputed: Column, human: Column) -> Column:
    return (not_sure | spot_check | disputed) & human.isNull()


def spot_check(item_id: Column, is_answered: Column, rate: float = SPOT_CHECK_RATE, seed: int = 0) -> Column:
    """A repeatable share of the answered rows, drawn by hash so that retries choose the same rows."""
    buckets = 1_000_000
    digest = F.md5(F.concat(F.lit(f"{seed}|"), item_id.cast("string")))
    return is_answered & (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % buckets < int(rate * buckets))


def decode_codes(code: Column, names: Mapping[str, str]) -> Column:
    """Name of a code, null when unknown."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.try_element_at(table, code)


def text_with_fallback(texts: Column, chain: Sequence[str]) -> Column:
    """First non-blank trimmed text along a chain of languages, with the language used and a fallback flag."""
    trimmed = {lang: F.nullif(F.trim(F.try_element_at(texts, F.lit(lang))), F.lit("")) for lang in chain}
    lang = F.coalesce(*[F.when(trimmed[x].isNotNull(), F.lit(x)) for x in chain])
    return F.struct(F.coalesce(*trimmed.values(), F.lit("")).alias("text"),
                    F.coalesce(lang, F.lit("en")).alias("lang"),
                    (F.coalesce(lang, F.lit("en")) != chain[0]).alias("fallback"))


def position_to_cell(index: Column, per_row: int = 3, rows: int = 5) -> tuple[Column, Column]:
    """(row, place) of a running index, null beyond the protocol."""
    inside = index < per_row * rows
    return (F.when(inside, F.floor(index / per_row).cast("int") + 1),
            F.when(inside, (index % per_row).cast("int") + 1))


def checklist_referral(checklist: Column, question_ids: Sequence[str]) -> Column:
    ids = F.array(*[F.lit(q) for q in question_ids])
    return F.exists(F.map_entries(checklist), lambda e: (e["value"] == "yes") & F.array_contains(ids, e["key"]))


def visit_verdict(n_answered: Column, n_problem: Column, n_trees: Column) -> Column:
    return (F.when((n_problem >= 3) | (n_trees >= 2), "officer_alert").when(n_problem >= 1, "some_problem")
            .when(n_answered > 0, "all_healthy"))


def percent_format(p: Column) -> Column:
    """Display form of a probability; the ends are not shown as 0% or 100%."""
    return (F.when(p.isNull() | F.isnan(p), "–").when(p > 0.995, ">99%").when(p < 0.005, "<1%")
            .otherwise(F.concat(F.floor(p * 100 + 0.5).cast("bigint").cast("string"), F.lit("%"))))


def device_class(user_agent: Column) -> Column:
    return F.when(user_agent.rlike("iPhone|Android|Mobile"), "phone").otherwise("laptop/tablet")
