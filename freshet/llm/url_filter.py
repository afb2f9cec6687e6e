"""Verdicts on URLs by explicit rules and by mined token combinations (operator 5).

Explicit rules name a host and a path; the longest that fits decides. For the rest,
association rules decide: FP-growth mines combinations of URL tokens together with the
label "bad", combinations of enough support and confidence become rules, and an inverted
index from a rule's rarest token to the rule finds those whose tokens are all in a URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.runtime import join_groups, partitions, table

BAD = "label=bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (rule, verdict): fixed values.
DEFAULT_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case, and then up to `?`, `#` or the end; both empty without `://`."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def rule_verdicts(host: Column, path: Column, rules=DEFAULT_RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path, or nulls.

    A rule fits its host and all subdomains if the path starts with its own. Few rules stand
    in the plan itself; they are a parameter, not data.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, way = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + way)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: host labels and the words inside them, path parts and the words inside them, each marked by where it stands."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    words = F.filter(F.flatten(F.transform(labels, lambda x: F.split(x, "[-_]"))), lambda x: x != "")
    whole = F.split(F.lower(path), r"[/.]")
    parts = F.filter(F.concat(whole, F.flatten(F.transform(whole, lambda x: F.split(x, "[-_]")))), lambda x: (x != "") & ~x.rlike("^[0-9]+$"))
    return F.array_distinct(F.concat(F.transform(labels, lambda x: F.concat(F.lit("host="), x)), F.transform(words, lambda x: F.concat(F.lit("word="), x)), F.transform(parts, lambda x: F.concat(F.lit("path="), x))))


def mine_rules(labelled: DataFrame, min_support: float = 0.002, min_count: int = 5, min_confidence: float = 0.6, min_lift: float = 1.5) -> DataFrame:
    """(tokens, confidence, support) of token combinations that foretell BAD; `labelled` has tokens array<string> and bad boolean.

    A combination needs `min_support` of all rows, and `min_count` bad ones at least.
    Tokens that are always together, in good rows as in bad ones, count as one of them (merge_twins).
    A combination is dropped if a part of it has the same or a greater confidence. No
    labelled row, no rule.
    """
    from pyspark.ml.fpm import FPGrowth

    baskets = table(labelled.where("bad is not null and size(tokens) > 0").select(F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items"), F.monotonically_increasing_id().alias("row")), "baskets")
    rows = baskets.agg(F.count("*").alias("rows"), F.count_if(F.array_contains("items", BAD)).alias("bad")).first()
    empty = baskets.select(F.col("items").alias("tokens"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support")).limit(0)
    if rows["bad"] < max(1, min_count):
        return empty
    # only combinations with BAD can be rules: mine the bad baskets, then count each combination in all of them
    bad = merge_twins(baskets.select("row", F.array_remove("items", BAD).alias("items"), F.array_contains("items", BAD).alias("bad"))).where("bad").select("items")
    share = min(1.0, max(min_support * rows["rows"], min_count) / rows["bad"])
    frequent = FPGrowth(itemsCol="items", minSupport=share, minConfidence=1.0).fit(bad).freqItemsets
    sets = table(frequent.select(F.array_sort("items").alias("tokens"), F.col("freq").alias("n_bad")).distinct(), "frequent-sets")
    counted = matches(baskets.select("row", F.col("items").alias("tokens")), sets.select("tokens")).groupBy("rule_tokens").agg(F.count("*").alias("n"))
    rules = sets.join(counted, sets.tokens == counted.rule_tokens).select("tokens", (F.col("n_bad") / F.col("n")).alias("confidence"), (F.col("n_bad") / rows["rows"]).alias("support"))
    base = rows["bad"] / rows["rows"]
    good = table(rules.where((F.col("confidence") >= min_confidence) & (F.col("confidence") >= min(1.0, min_lift * base))), "mined-rules")
    # a rule is redundant if a shorter one made of its tokens is as sure
    parts = matches(good.select(F.xxhash64("tokens").alias("row"), "tokens", F.col("confidence").alias("own")), good.select("tokens", "confidence"))
    spare = parts.where("size(rule_tokens) < size(tokens) and confidence >= own").select("row").distinct()
    return table(good.withColumn("row", F.xxhash64("tokens")).join(spare, "row", "left_anti").drop("row"), "rules")


def merge_twins(baskets: DataFrame) -> DataFrame:
    """(row, bad, items) of baskets (row, items, bad), with one token, the least, of those that are in the very same baskets.

    A rule with a twin in another's place has the same support and confidence, and one URL
    that is in many baskets would else add two to the power of its tokens to the frequent
    sets. Tokens are compared by the number and a 128-bit digest of their baskets.
    """
    each = baskets.select("row", "bad", F.explode("items").alias("token"))
    where = each.groupBy("token").agg(F.count("*").alias("many"), F.bit_xor(F.xxhash64("row")).alias("a"), F.bit_xor(F.xxhash64("row", F.lit("twin"))).alias("b"))
    kept = table(where.groupBy("many", "a", "b").agg(F.min("token").alias("token")).select("token", "many"), "tokens")
    total = kept.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]
    # tokens grow with the baskets: only hot ones are sent to all tasks
    return join_groups(each, kept.hint("merge"), ["token"], "many", total).groupBy("row", "bad").agg(F.collect_list("token").alias("items"))


def matches(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """`rows` (with tokens) with each rule all of whose tokens they have, as rule_tokens and the rule's other columns.

    The index lists a rule under one token, the one that fewest rows have, so that a common
    token brings no rows together; Spark chooses how to join by the sizes it finds.
    """
    each = rules.select(F.col("tokens").alias("rule_tokens"), *[c for c in rules.columns if c != "tokens"])
    spread = each.withColumn("token", F.explode("rule_tokens"))
    wanted = spread.select("token").distinct()
    many = rows.select(F.explode("tokens").alias("token")).join(wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("many"))
    index = spread.join(many, "token", "left").groupBy("rule_tokens").agg(F.min(F.struct(F.coalesce("many", F.lit(0)).alias("many"), "token"))["token"].alias("token"), *[F.first(c).alias(c) for c in each.columns if c != "rule_tokens"])
    return rows.withColumn("token", F.explode("tokens")).join(index, "token").where(F.size(F.array_except("rule_tokens", "tokens")) == 0).drop("token")


def judge_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id_col: str = "doc_id", rules=DEFAULT_RULES, **mining) -> DataFrame:
    """(id, host, path, rule, verdict, mined_confidence) of every row of `pages`.

    Labels (quality and toxic, by the pages' id) mark a page as bad if its quality is 0 or
    toxic is 1; only pages that no explicit rule fits are learned from and judged by mined
    rules: block if one fits, else allow. mined_confidence is the greatest of the rules that
    fit, else null. Null urls, and those without `://`, have empty host and path and are
    allowed. Rows repeat as they do in `pages`; of several labels for an id, one bad is
    enough; other columns are ignored.
    """
    url = F.col(f"`{url_col}`").cast("string")
    host, path = host_and_path(url)
    own = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_verdicts(F.col("host"), F.col("path"), rules)
    own = own.withColumn("rule", rule).withColumn("rule_verdict", verdict)
    bad = labels.select(F.col(f"`{label_id_col}`").alias("label_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")).where("label_id is not null").groupBy("label_id").agg(F.max("bad").alias("bad"))
    places = table(own.groupBy("host", "path", "rule").agg(F.count("*").alias("many")), "places")  # each place is judged once
    open_places = places.where("rule is null").select("host", "path", url_tokens(F.col("host"), F.col("path")).alias("tokens"))
    known = own.where("rule is null").join(bad.hint("merge"), F.col("id") == F.col("label_id")).select(url_tokens(F.col("host"), F.col("path")).alias("tokens"), "bad")
    mined = mine_rules(known, **mining)
    hit = table(matches(open_places, mined).groupBy("host", "path").agg(F.max("confidence").alias("mined_confidence")), "hits")
    # a place that more pages share than a partition holds on average goes to all tasks: there are fewer of those than partitions
    total = places.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]
    hot = places.where(F.col("many") > max(1, total // partitions(pages.sparkSession))).select("host", "path").join(hit, ["host", "path"], "left").withColumn("hot", F.lit(True))
    marked = own.join(F.broadcast(hot), ["host", "path"], "left")
    cold = marked.where("hot is null").drop("mined_confidence").join(hit.hint("merge"), ["host", "path"], "left")
    out = marked.where("hot").unionByName(cold)
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("rule_verdict", F.when(F.col("mined_confidence").isNotNull(), F.lit("block")), F.lit("allow")).alias("verdict"), F.when(F.col("rule").isNull(), F.col("mined_confidence")).alias("mined_confidence"))
