"""Personal data: overlapping candidates, boosted trees over format and context, calibrated
thresholds; in the JVM alone.

Generators propose spans with high recall. Spans that pass their kind's fixed rules are
always reported. Of the others, trees decide: they are learned from the corpus itself,
where a candidate counts as right if it overlaps a span of its kind that passed or if its kind's own check
holds (``checks`` of persons' and accounts' numbers, ``random_looking`` secrets, known heads of keys, bracketed
addresses), on features that show little of the rule (lengths, separators, neighbours, words before). Features
are small whole numbers, so the training set is a table of counts of at most ``MOST_ROWS`` rows. The trees
become one SQL expression; a kind's threshold is the lowest score that keeps ``PRECISION`` on the texts held out
from the fit. Where a kind has fewer than ``LEAST`` examples held out that its check accepts, nothing can be
calibrated and the check decides alone; a kind with enough examples that never reaches ``PRECISION`` adds nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyrank.llm import boosting
from storyrank.llm.text import whole
from storyrank.session import stage

KINDS = ("email", "ip", "card", "phone", "id", "secret")
# The base patterns. Possessive where giving back could not help, and started
# only where a run starts or the last match ended, so that long runs cost linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = (
    ("email", r"[A-Za-z0-9._%+-]{1,64} ?[(\[{] ?at ?[)\]}] ?[A-Za-z0-9-]{1,63}(?: ?(?:[(\[{] ?dot ?[)\]}]|\.) ?[A-Za-z0-9-]{1,63}){1,4}"),
    ("phone", r"(?<![0-9])(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])(?:[0-9]{2,4}[ .-]){1,3}[0-9]{2,4}(?![0-9])"),
    ("id", r"(?<![A-Za-z0-9-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9-])"),
    # A value given to a name of a secret.
    ("secret", r"(?<=[\"':= ])(?<=(?i:passwo?r?d|pwd|passphrase|secret|token|key|credentials?)[\"']?[ \t]{0,2}[:=][ \t]{0,2}[\"']?)[^\s\"',;<>&()]{8,}+"),
    # Heads that well-known issuers give their keys and tokens.
    ("secret", r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}+|sk[-_][A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+"
               r"|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+(?:\.[A-Za-z0-9_-]++)?)"),
)
HINT = {"email": "[@(\\[{]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]", "id": "[0-9]",
        "secret": "(?i:pass|pwd|secret|token|key|credential)|AKIA|ASIA|gh[pousr]_|sk[-_]|xox|AIza|eyJ"}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
CONTEXT = {  # words in the last characters before a candidate
    "mail": r"(?:mail|contact|write|addres)", "phone": r"(?:phone|tel\b|tel[:.]|call|mobile|fax|whatsapp)",
    "card": r"(?:card|visa|master|credit|iban|account|pay)", "host": r"(?:\bip\b|host|server|addr)",
    "other": r"(?:version|\bv\.?$|isbn|order|invoice|page|token|key|id\b|no\.?$|#)",
}
EMAIL_LOOSE, KEY_HEADS = len(BASE), len(BASE) + len(LOOSE) - 1  # generators whose form is the check
BEFORE, AFTER = 24, 2
PRECISION = 0.8  # against spans that passed only: the right ones among the others count as wrong here
LEAST = 20  # accepted examples that a threshold rests on
BINS = {"gen": 9, "length": 6, "digits": 6, "groups": 4, "parens": 2, "before": 3, "after": 3, "word": 6}
MOST_ROWS = 2 * 2 * int(np.prod(list(BINS.values())))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost matches that do not overlap, as structs of start, stop (code points), the
    match and the text around it. The text between matches gives their places."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.char_length(F.get(gaps, i))
        stop = start + F.char_length(F.get(found, i))
        one = F.struct(start.alias("start"), stop.alias("stop"), F.get(found, i).alias("m"),
                       F.right(F.get(gaps, i), F.lit(BEFORE)).alias("pre"), F.left(F.get(gaps, i + 1), F.lit(AFTER)).alias("post"))
        return F.struct(stop.alias("at"), F.array_append(acc["all"], one).alias("all"))

    empty = F.array().cast(f"array<{SPOT}>")
    zero = F.struct(F.lit(0).alias("at"), empty.alias("all"))
    return F.when(F.size(found) > 0, F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), zero, step, lambda a: a["all"])
                  ).otherwise(empty)


SPOT = "struct<start:int,stop:int,m:string,pre:string,post:string>"


def valid(kind: Column, m: Column) -> Column:
    """The fixed rules of a base match."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.char_length(digits)
    return (F.when(kind == "email", F.lit(True))
            .when(kind == "ip", m.rlike(rf"^{PART}(?:\.{PART}){{3}}$"))
            .when(kind == "card", n.between(14, 19) & F.when(n.between(14, 19), F.call_function("luhn_check", digits)).otherwise(False))
            .when(kind == "phone", n.between(10, 15)).otherwise(F.lit(False)))


def checks(m: Column) -> Column:
    """The check of an ``id`` candidate: an account number's remainder by 97 (ISO 13616), or a
    social security number in the ranges that are given out."""
    plain = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.left(plain, F.lit(4)))
    value = lambda c: F.ascii(c) - F.when(c.rlike("[0-9]"), 48).otherwise(55)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(
        c == "", acc).otherwise((acc * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97))
    account = m.rlike("^[A-Z]") & F.char_length(plain).between(15, 34) & (rest == 1)
    return account | m.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")


def random_looking(m: Column) -> Column:
    """The check of a secret: letters and digits mixed, few of them twice."""
    different = F.size(F.array_distinct(F.split(m, "")))
    return m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (different >= F.least(F.lit(10), F.ceil(F.char_length(m) * 0.6)))


def _level(c: Column, *cuts: int) -> Column:
    out = F.lit(len(cuts))
    for k in reversed(range(len(cuts))):
        out = F.when(c <= cuts[k], k).otherwise(out)
    return out


def _neighbour(c: Column) -> Column:
    return F.when(c.rlike("^\\s?$"), 0).when(c.rlike("[\\p{L}0-9]"), 1).otherwise(2)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each proposed span, and one without a kind for each text without any:
    ``doc_id, th, kind, start, stop, base, checked`` and the features. Repeated rows give one text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(F.col(text_col)).alias("t"))
    rows = rows.withColumn("th", F.struct(F.xxhash64("t").alias("a"), F.xxhash64(F.lit(7), "t").alias("b")))
    no = 0
    lists = []
    for rule, patterns in ((True, BASE.items()), (False, LOOSE)):
        for kind, pattern in patterns:
            got = F.when(F.col("t").rlike(HINT[kind]), matches(F.col("t"), pattern)).otherwise(
                F.array().cast(f"array<{SPOT}>"))
            lists.append((no, kind, rule, got))
            no += 1
    rows = rows.withColumns({f"g{n}": got for n, _, _, got in lists})
    def tagged(n: int, kind: str, rule: bool) -> Column:
        return F.transform(f"g{n}", lambda s: F.struct(
            F.lit(n).alias("gen"), F.lit(kind).alias("kind"), F.lit(rule).alias("rule"), s.alias("s")))

    every = F.concat(*[tagged(n, kind, rule) for n, kind, rule, _ in lists])
    spans = rows.select("doc_id", "th", F.explode_outer(every).alias("c")).select(
        "doc_id", "th", "c.gen", "c.kind", "c.rule", "c.s.*")
    spans = spans.withColumn("base", F.coalesce(F.col("rule") & valid(F.col("kind"), F.col("m")), F.lit(False)))
    pre, m = F.lower("pre"), F.col("m")
    word = F.lit(0)
    for k, pattern in enumerate(CONTEXT.values(), 1):
        word = F.when(pre.rlike(pattern), k).otherwise(word)
    # A sign of the rule right before (a plus and a country's number) must not be seen.
    pre_char = F.right(F.regexp_replace("pre", r"\+[0-9]{1,3} ?$", " "), F.lit(1))
    return spans.select(
        "doc_id", "th", "kind", "start", "stop", "base",
        (F.when(F.col("gen").isin(EMAIL_LOOSE, KEY_HEADS), True).when(F.col("kind") == "id", checks(m))
         .when(F.col("kind") == "secret", random_looking(m)).otherwise(F.lit(False))).alias("checked"), "gen",
        _level(F.char_length(m), 10, 12, 15, 19, 28).alias("length"),
        _level(F.char_length(F.regexp_replace(m, "[^0-9]", "")), 3, 8, 10, 13, 15).alias("digits"),
        _level(F.size(F.split(m, "[^A-Za-z0-9]+")), 1, 2, 4).alias("groups"),
        m.rlike("[()]").cast("int").alias("parens"), _neighbour(pre_char).alias("before"),
        _neighbour(F.left("post", F.lit(1))).alias("after"), word.alias("word")).distinct()


def with_overlap(spans: DataFrame) -> DataFrame:
    """``near_base``: the span overlaps one that passed the rules, or is one; ``same_kind``:
    one of its own kind."""
    def touches(*keys: str) -> Column:
        order = Window.partitionBy("doc_id", "th", *keys).orderBy("start", "stop", "kind", "gen")
        back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
        stop = F.max(F.when(F.col("base"), F.col("stop"))).over(back)
        start = F.min(F.when(F.col("base"), F.col("start"))).over(ahead)
        return F.coalesce(stop > F.col("start"), F.lit(False)) | F.coalesce(start < F.col("stop"), F.lit(False))

    return spans.withColumns({"near_base": touches(), "same_kind": touches("kind")})


def expression(trees: boosting.Trees, names: list[str]) -> Column:
    """The trees' sum as one expression over the feature columns."""
    inner = (1 << trees.depth) - 1

    def walk(tree: int, node: int) -> Column:
        if node >= inner:
            return F.lit(float(trees.value[tree][node - inner]))
        cut = float(trees.threshold[tree][node])
        if cut == float("inf"):
            return walk(tree, 2 * node + 1)
        test = F.col(names[trees.feature[tree][node]]) <= F.lit(cut)
        return F.when(test, walk(tree, 2 * node + 1)).otherwise(walk(tree, 2 * node + 2))

    total = F.lit(trees.base)
    for tree in range(len(trees.value)):
        total = total + walk(tree, 0)
    return total


def learn(spans: DataFrame, trees: int = 30, depth: int = 3) -> tuple[boosting.Trees, dict[str, float]]:
    """Trees and each kind's threshold from the counts of feature rows."""
    names = list(BINS)
    held = F.pmod(F.xxhash64("doc_id", "th"), F.lit(5)) == 0
    seen = F.col("same_kind") | F.col("checked")
    table = spans.filter("kind is not null").groupBy(*names, held.alias("held"), seen.alias("y")).agg(
        F.count(F.lit(1)).alias("n")).collect()  # MOST_ROWS at most
    table.sort(key=lambda r: tuple(r))
    x = np.array([[r[c] for c in names] for r in table], dtype=float).reshape(len(table), len(names))
    y = np.array([r["y"] for r in table], dtype=float)
    n = np.array([r["n"] for r in table], dtype=float)
    out = np.array([r["held"] for r in table], dtype=bool)
    fitted = boosting.fit(x[~out], y[~out], n[~out], trees=trees, depth=depth, rate=0.3)
    score = fitted.margin(x) if len(table) else np.empty(0)
    kinds = np.array([([*BASE, *[k for k, _ in LOOSE]][int(g)]) for g in x[:, 0]]) if len(table) else np.empty(0, dtype=str)
    limits = {}
    for kind in KINDS:
        mine = out & (kinds == kind)
        order = np.argsort(-score[mine], kind="stable")
        hit, all_ = (y * n)[mine][order].cumsum(), n[mine][order].cumsum()
        s = score[mine][order]
        last = np.append(s[1:] != s[:-1], True) if len(s) else np.empty(0, dtype=bool)
        good = np.flatnonzero(last & (hit >= PRECISION * all_) & (all_ >= LEAST))
        if len(good):
            limits[kind] = float(s[good[-1]])
        elif len(hit) and hit[-1] >= LEAST:
            limits[kind] = float("inf")
    return fitted, limits


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, th, spans)``: for every text its spans in order, structs of start, kind's
    number, stop and ``base``. Null text is empty; a null id is an id like any other;
    repeated rows (same id, same text) give one row, an id with several texts one for each.
    Of added spans that overlap, the one with the higher score stays."""
    spans = stage(with_overlap(candidates(docs, id_col, text_col)))
    trees, limits = learn(spans)
    margin = expression(trees, list(BINS))
    limit = F.lit(None).cast("double")
    for kind, value in limits.items():
        limit = F.when(F.col("kind") == kind, F.lit(value)).otherwise(limit)
    chosen = spans.withColumn("score", margin).withColumn(
        "ok", F.col("base") | F.coalesce(~F.col("near_base") & F.when(limit.isNull(), F.col("checked")).otherwise(F.col("score") >= limit), F.lit(False)))
    added = F.col("ok") & ~F.col("base")
    order = Window.partitionBy("doc_id", "th", "ok").orderBy("start", "stop", "kind", "gen")
    rank = lambda get: (get("score"), get("stop") - get("start"))
    before, after = lambda c: F.lag(c).over(order), lambda c: F.lead(c).over(order)

    def beaten(other, by_tie: bool) -> Column:
        touching = (other("start") < F.col("stop")) & (other("stop") > F.col("start"))
        better = (other("score") > F.col("score")) | ((other("score") == F.col("score")) & F.lit(by_tie))
        return F.coalesce(touching & better & ~other("base"), F.lit(False))

    kept = chosen.withColumn("keep", F.col("ok") & (F.col("base") | ~(beaten(before, True) | beaten(after, False))))
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    one = F.when(F.col("keep"), F.struct("start", number.alias("kind"), "stop", "base"))
    return kept.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(one)).alias("spans"))


def joined(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["stop"])))


def report(docs: DataFrame) -> DataFrame:
    """The spans of every text as counts, digest and text."""
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long")
    return find(docs).select(
        "doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; null text stays null."""
    found = find(docs, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("spans").alias("__spans"))
    text = whole(F.col(text_col))
    mark = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))
    name = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.substring(F.col(text_col), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"),
                        F.concat(acc["out"], piece, F.when(fresh, F.get(name, s["kind"])).otherwise("")).alias("out"))

    rest = lambda a: F.concat(a["out"], F.substring(F.col(text_col), a["at"] + 1, F.char_length(text_col)))
    both = docs.withColumn("__mark", mark).join(
        found, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__mark") == F.col("__th")), "left")
    return both.withColumn(text_col, F.when(F.size("__spans") > 0, F.aggregate("__spans", zero, step, rest)).otherwise(
        F.col(text_col))).drop("__mark", "__id", "__th", "__spans")
