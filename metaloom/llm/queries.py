"""The llm operators as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloom.llm import lookalike, mixing, packing, survivors, tokens
from metaloom.llm.sql import SQL
from metaloom.registry import Registry
from metaloom.util import cut

R = Registry()


def _budgets(t):
    """A fixed table of a few rows."""
    return [(r.budget_name, r.capacity_tokens) for r in t("token_budgets").select("budget_name", "capacity_tokens").collect()]


@R.add("p1_found", SQL["p1_found"])
def p1_found(t):
    return survivors.survivors(t("data_discovery"), values=False).drop("value")


@R.add("p1_fused", SQL["p1_fused"])
def p1_fused(t):
    return survivors.fused(t("data_discovery"))


@R.add("p1_precedence", SQL["p1_precedence"])
def p1_precedence(t):
    return survivors.precedence(survivors.transitions(cut(survivors.observations(t("data_discovery")), "usable")))


@R.add("p1_undated", SQL["p1_undated"])
def p1_undated(t):
    """The times of scans that arrived over a day late are not trusted and count as missing."""
    d = t("data_discovery")
    late = F.col("created_at") > F.col("discovered_at") + F.expr("interval 1 day")
    return survivors.survivors(d.withColumn("discovered_at", F.when(~late, F.col("discovered_at"))))


@R.add("p6_pack")
def p6_pack(t):
    return packing.pack_documents(t("documents"), _budgets(t))


@R.add("p6_fill")
def p6_fill(t):
    b = _budgets(t)
    return packing.fill_report(packing.placements(t("documents"), b), b)


@R.add("p7_mix")
def p7_mix(t):
    return mixing.mix(t("documents"), t("mix_targets"))[0]


@R.add("p7_shares")
def p7_shares(t):
    return mixing.mix(t("documents"), t("mix_targets"))[1]


@R.add("p7_shares_all")
def p7_shares_all(t):
    """Mixes as large as all their sources together: scarce sources go to their cap, and the shares show it."""
    return mixing.mix(t("documents"), t("mix_targets"), total_tokens="available")[1]


@R.add("p8_found")
def p8_found(t):
    return lookalike.same_look_pairs(t("documents"))


@R.add("p8_classes")
def p8_classes(t):
    return lookalike.look_classes(t("documents"))


@R.add("p8_forms")
def p8_forms(t):
    return lookalike.forms(t("documents"))


@R.add("p8_report")
def p8_report(t):
    """How many candidates the normal form finds and how many of them the check rejects."""
    return lookalike.look_report(t("documents"))


@R.add("p6_tokens")
def p6_tokens(t):
    return tokens.token_counts(t("documents").select("doc_id", "source", "text"))
