"""Operator 9: URL rules, and gradient-boosted trees on lexical features for the URLs that no rule decides.

Everything is DataFrame columns: the features are expressions, a tree's level is one grouped sum of gradients over binned
features, and the fitted trees are scored as nested CASE expressions inside the scan's own stage."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagflow.llm.common import discard, own, prepared, stored, table


@dataclass(frozen=True)
class Rule:
    """Fits its host and all subdomains where the path starts with its own."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        host = (F.col("host") == self.host) | F.col("host").endswith("." + self.host)
        return host & F.col("path").startswith(self.path)


RULES = [
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
]

#: Labelled URLs the trees are fitted on, about so many at most; rounds, depth and step of the boosting.
FIT_ROWS, ROUNDS, DEPTH, STEP, L2 = 20_000, 12, 3, 0.4, 1.0
#: Labelled URLs a suffix must have before its own rate outweighs the overall rate.
SUFFIX_PRIOR = 20.0
#: Suffixes and segments whose rates may be sent to every task; more are joined, with the same verdicts.
SENT_RATES = 200_000


def parts(urls: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, host, path. Without "://", or null: host and path are empty."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.substring("url", at + 3, F.length("url"))).otherwise(F.lit(""))
    host = F.regexp_extract("rest", r"^[^/?#]*", 0)
    # only A-Z are lowered
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (
        own(urls, page_id=key, url=url)
        .withColumn("rest", F.coalesce(rest, F.lit("")))
        .select("page_id", "url", host.alias("host"), F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))
    )


def with_rule(frame: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds rule and rule_verdict of the longest rule that fits, null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is asked first, being outermost
        name = F.when(rule.fits(), F.lit(rule.text)).otherwise(name)
        verdict = F.when(rule.fits(), F.lit(rule.verdict)).otherwise(verdict)
    return frame.withColumns({"rule": name, "rule_verdict": verdict})


def features() -> dict[str, Column]:
    """Lexical features of url, host and path, each a number from 0 up; the bins are whole numbers."""
    url = F.coalesce(F.col("url"), F.lit(""))
    size = F.length(url)
    digits = size - F.length(F.translate(url, "0123456789", ""))
    letters = "abcdefghijklmnopqrstuvwxyz0123456789-._~:/?#=&%+"
    low = F.lower(url)
    entropy = F.lit(0.0)
    for c in letters:
        n = (size - F.length(F.translate(low, c, ""))) / F.greatest(size, F.lit(1))
        entropy = entropy - F.when(n > 0, n * F.log2(n)).otherwise(0.0)
    count = lambda column, c: F.length(column) - F.length(F.translate(column, c, ""))
    return {
        "length": F.least(size / 8, F.lit(31)),
        "path_length": F.least(F.length("path") / 4, F.lit(31)),
        "depth": F.least(count(F.col("path"), "/"), F.lit(15)),
        "labels": F.least(count(F.col("host"), "."), F.lit(15)),
        "hyphens": F.least(count(F.col("host"), "-"), F.lit(7)),
        "digit_ratio": F.floor(32 * digits / F.greatest(size, F.lit(1))),
        "entropy": F.floor(entropy * 4),
        "parameters": F.when(F.instr(url, "?") > 0, F.least(1 + count(url, "&"), F.lit(15))).otherwise(0),
        "fragment": F.when(F.instr(url, "#") > 0, 1).otherwise(0),
        "first_letter": F.coalesce(F.ascii(F.substring("path", 2, 1)) % 64, F.lit(0)),
        "second_letter": F.coalesce(F.ascii(F.substring_index(F.substring_index("path", "/", 3), "/", -1)) % 64, F.lit(0)),
        "suffix_rate": F.floor(F.col("suffix_rate") * 31),
        "path_rate": F.floor(F.col("path_rate") * 31),
    }


def suffixes() -> dict[str, Column]:
    """The host's last label and the path's first segment, whose statistics are learnt."""
    return {"suffix": F.substring_index("host", ".", -1), "segment": F.substring_index(F.substring("path", 2, 1 << 20), "/", 1)}


@dataclass
class Trees:
    """A fitted model; nodes are (feature, bin, left, right), leaves are numbers."""

    bias: float
    trees: list
    rates: DataFrame
    overall: float
    sent: bool = True

    def margin(self) -> Column:
        def value(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            name, at, left, right = node
            return F.when(F.col(name) <= at, value(left)).otherwise(value(right))

        total = F.lit(self.bias)
        for tree in self.trees:
            total = total + value(tree)
        return total


def featured(frame: DataFrame, rates: DataFrame, overall: float, sent: bool = True) -> DataFrame:
    """Adds the binned features. rates has one row per suffix or segment of the labelled URLs; it is broadcast if it is small."""
    frame = frame.withColumns(suffixes())
    for kind, column in (("suffix", "suffix_rate"), ("segment", "path_rate")):
        one = rates.where(F.col("kind") == kind).select(F.col("value").alias(kind), F.col("rate").alias(column))
        frame = frame.join(F.broadcast(one) if sent else one, kind, "left").withColumn(column, F.coalesce(F.col(column), F.lit(overall)))
    return frame.withColumns({k: F.floor(v).cast("int") for k, v in features().items()})


def sampled(labelled: DataFrame, rows: int, total: int) -> DataFrame:
    """About `rows` of `total` rows, the same in every run: those whose hash lies in the lowest share of all 64-bit numbers."""
    if rows >= total:
        return labelled
    below = -(1 << 63) + (rows << 64) // total
    return labelled.where(F.xxhash64("page_id", "url") < F.lit(below))


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS, rounds: int = ROUNDS, depth: int = DEPTH, sent_rates: int = SENT_RATES) -> Trees | None:
    """Logistic boosting on labelled (page_id, url, host, path, label) rows; None without both labels.

    Suffix and segment statistics are those of all labelled rows. The trees are fitted on a sample of about fit_rows, a documented
    bound. Should a sample of so many rows hold one label only, that is an error and not a model that allows everything."""
    seen = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones")).first()
    total, ones = seen["n"], seen["ones"] or 0
    if not 0 < ones < total:
        return None
    overall = ones / total
    each = labelled.withColumns(suffixes()).select("label", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("suffix", "segment")])).alias("x"))
    rate = (F.sum("label") + SUFFIX_PRIOR * overall) / (F.count(F.lit(1)) + SUFFIX_PRIOR)
    rates = stored(each.groupBy("x.kind", "x.value").agg(rate.alias("rate")))
    sent = rates.count() <= sent_rates

    names = list(features())
    sample = sampled(labelled, fit_rows, total).withColumn("label", F.col("label").cast("double"))
    data = stored(featured(sample, rates, overall, sent).groupBy("label", *names).agg(F.count(F.lit(1)).alias("weight")).coalesce(4))
    held = data.agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("ones")).first()
    if not 0 < (held["ones"] or 0) < (held["n"] or 0):
        raise ValueError(f"a sample of {fit_rows} of {total} labelled URLs holds one label only: raise fit_rows")
    share = held["ones"] / held["n"]
    model = Trees(math.log(share / (1 - share)), [], rates, overall, sent)
    for _ in range(rounds):
        model.trees.append(_tree(data, model, names, depth))
    discard(data)
    return model


def _tree(data: DataFrame, model: Trees, names: list[str], depth: int):
    """One tree: each level is one grouped sum of gradients and Hessians by (node, feature, bin); bins and nodes are few."""
    p = 1 / (1 + F.exp(-model.margin()))
    scored = data.withColumns({"p": p}).withColumns({"g": F.col("weight") * (F.col("p") - F.col("label")), "h": F.col("weight") * F.col("p") * (1 - F.col("p"))})
    splits: dict[int, tuple[str, int]] = {}
    leaves: dict[int, float] = {}
    node = F.lit(1)
    open_nodes = {1}
    for _ in range(depth):
        pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("bin")) for n in names])).alias("x")
        rows = scored.withColumn("node", node).select("node", "g", "h", pairs).groupBy("node", "x.feature", "x.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        table_: dict = {}
        for r in rows:
            if r["node"] in open_nodes:
                table_.setdefault(r["node"], {}).setdefault(r["feature"], []).append((r["bin"], r["g"], r["h"]))
        now = set()
        for n, by in table_.items():
            some = next(iter(by.values()))
            total_g, total_h = sum(x[1] for x in some), sum(x[2] for x in some)
            best = (1e-6, None, None, 0.0, 0.0)
            for name in names:
                left_g = left_h = 0.0
                for at, g, h in sorted(by[name])[:-1]:
                    left_g, left_h = left_g + g, left_h + h
                    gain = left_g**2 / (left_h + L2) + (total_g - left_g) ** 2 / (total_h - left_h + L2) - total_g**2 / (total_h + L2)
                    if gain > best[0] + 1e-9:
                        best = (gain, name, at, left_g, left_h)
            leaves[n] = round(-STEP * total_g / (total_h + L2), 9)
            if best[1] is not None:
                splits[n] = best[1:3]
                now |= {2 * n, 2 * n + 1}
                # the sums on both sides are the children's
                leaves[2 * n] = round(-STEP * best[3] / (best[4] + L2), 9)
                leaves[2 * n + 1] = round(-STEP * (total_g - best[3]) / (total_h - best[4] + L2), 9)
        if not now:
            break
        step = F.lit(0)
        for n, (name, at) in splits.items():
            if 2 * n in now:
                step = F.when(node == n, F.when(F.col(name) <= at, F.lit(2 * n)).otherwise(F.lit(2 * n + 1))).otherwise(step)
        node, open_nodes = step, now

    def build(n: int):
        return (*splits[n], build(2 * n), build(2 * n + 1)) if n in splits else leaves.get(n, 0.0)

    return build(1)


def verdicts(urls: DataFrame, rules: list[Rule] = RULES, key: str = "page_id", url: str = "url", fit_rows: int = FIT_ROWS, sent_rates: int = SENT_RATES) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block.

    URLs that a rule decides are the labelled ones; the trees learn from a bounded sample of them and judge the rest (block
    where p_block > 0.5). The scoring pass is narrow as long as there are at most sent_rates suffixes and segments.
    Null or relative URLs have empty host and path, so no rule, and are judged like any other. Without labelled URLs of both
    kinds, what no rule decides is allowed. Repeated rows are judged alike, an empty table gives no rows."""
    prepared(urls.sparkSession)
    ruled = with_rule(parts(urls, key, url), rules)
    labelled = ruled.where(F.col("rule").isNotNull()).withColumn("label", (F.col("rule_verdict") == "block").cast("int"))
    model = fit(labelled, fit_rows, sent_rates=sent_rates)
    if model is None:
        return ruled.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("p_block"))
    scored = featured(ruled, model.rates, model.overall, model.sent).withColumn("p_block", 1 / (1 + F.exp(-model.margin())))
    own_verdict = F.when(F.col("p_block") > 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", own_verdict).alias("verdict"), "p_block")


def op9_urls(spark, sf_dir):
    return verdicts(table(spark, sf_dir, "pages"))
