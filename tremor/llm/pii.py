"""Personal data by weakly supervised span labelling (operator 4), in SQL functions only.

Candidates are the base matches (e-mail, ip, card, phone by fixed patterns), which always stay, and looser
ones, which the method judges: e-mails written with [at], phone numbers without a plus sign, long digit
runs, identity numbers, account numbers and secrets. Five labelers vote on each looser candidate
(1 yes, 0 no, -1 abstain): strict form, a gazetteer (host endings, area codes, key prefixes), the words before
it, its shape, and checksums. Votes are counted by pattern over all documents (at most 3 ** 5 patterns);
expectation-maximisation on these counts, inside one SQL ``aggregate``, estimates how often each labeler
says yes, no or nothing on real and on false spans; of the two classes, the real one is that with more yes and
fewer no votes. The posteriors then train the final span classifier, a naive Bayes model over kind,
length, digit share, context and checksum. A looser candidate becomes a span if the classifier gives it
at least one half; those that overlap base matches are no candidates. Texts are searched once: the candidates
are stored with their rows, then learned from and judged.

With ``by_kind`` (as in op4 and the pipeline) reliabilities and classifier are learned inside each kind, so a kind's other
candidates do not decide; three more labelers vote: the words after, the variety of characters, and runs of
plain words. An abstention is no evidence then, and what is known of each labeler beforehand (``KNOWN``; a random number passes
Luhn one time in ten, a real one does not fail it) weighs as much as the kind's candidates, whatever their number,
so a kind whose candidates all look alike, or are all false, is not split by force.

Edge cases: null and empty texts have no spans; positions are code points, ends exclusive; rows
that repeat and null doc_ids are searched row by row; without candidates, or without rows, nothing
is learned and only base spans come out; other columns, of any name and type but ``_pii_spans``, are passed through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.llm.workspace import documents, stored

KINDS = ["email", "ip", "card", "phone", "account", "identity", "secret"]
#: Fixed patterns. Possessive forms match the same text and cannot backtrack or overflow the stack;
#: the left borders only skip starts from which nothing can match.
BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[ -]?[0-9])++", r"[0-9](?:[ -]?[0-9]){15}"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]"),
}
_B = r"[\[(]"
_E = r"[\])]"
LOOSE = "|".join([
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?{_B}at{_E} ?[A-Za-z0-9-]++(?: ?(?:{_B}dot{_E}|\.) ?[A-Za-z0-9-]++)++",
    r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    r"(?<![0-9+A-Za-z])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z])[0-9]{13,19}+(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{20,}+(?![0-9A-Za-z_-])",
])
LOOSE_GUARD = rf"[0-9]{{2}}|{_B}at{_E}"
LABELERS = ["strict", "gazetteer", "context", "shape", "checksum"]
_YES = r"(?i)(?:e-?mail|mailto|phone|tel|call|fax|contact|card|visa|account|iban|ssn|token|key|secret|password|passwd|bearer|host|ip)\W{0,6}$"
_NO = r"(?i)(?:version|section|isbn|order|invoice|commit|revision|digest|checksum|md5|sha-?[0-9]*|uuid|page|no)\W{0,4}$"
#: Gazetteers: host endings, and beginnings of well-known kinds of keys.
_THEN_YES = r"(?i)^\W{0,4}(?:exp(?:ires)?|cvv|cvc|valid thru|ext|is my)\b"
_THEN_NO = r"(?i)^\W{0,4}(?:bytes|items|pieces|pages|files|lines|rows|records|commit|revision|checksum|digest|times)\b"
_HOSTS = r"(?i)(?:\.| ?[\[(]dot[\])] ?)(?:com|org|net|edu|gov|io|info|de|fr|es|uk)$"
_KEYS = r"^(?:sk|pk|rk)[-_]|^gh[opsu]_|^github_pat_|^glpat-|^xox[abprs]-|^AKIA|^ASIA|^AIza|^eyJ|^ya29"
_ISSUERS = r"^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})$"

def _matches(text: Column, kind: str) -> tuple[Column, Column]:
    """All matches of a pattern and the pieces between them; none unless the guard is met."""
    pattern, guard = (LOOSE, LOOSE_GUARD) if kind == "loose" else BASE[kind]
    hit = F.contains(text, F.lit(guard)) if guard == "@" else F.regexp_like(text, F.lit(guard))
    none = F.array().cast("array<string>")
    return F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none), F.when(hit, F.split(text, pattern, -1)).otherwise(none)


def _placed(m: str, p: str) -> Column:
    """(value, start, stop, before, after) of the matches ``m`` between the pieces ``p``."""
    steps = F.zip_with(F.col(m), F.slice(F.col(p), 1, F.size(m)), lambda v, q: F.struct(F.length(q).alias("gap"), F.length(v).alias("len")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(
        steps, zero, lambda acc, x: F.struct((acc["at"] + x["gap"] + x["len"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + x["gap"])).alias("starts"))
    )["starts"]
    return F.transform(
        F.arrays_zip(F.col(m).alias("value"), starts.alias("start"), F.slice(F.col(p), 1, F.size(m)).alias("piece"), F.slice(F.col(p), 2, F.size(m)).alias("next")),
        lambda x: F.struct(x["value"].alias("value"), x["start"].alias("start"), (x["start"] + F.length(x["value"])).alias("stop"), F.right(x["piece"], F.lit(24)).alias("before"), F.left(x["next"], F.lit(24)).alias("after")),
    )


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _octets(v: Column) -> Column:
    return F.regexp_like(v, F.lit(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$"))


def _base_ok(kind: str, v: Column) -> Column:
    d = _digits(v)
    if kind == "ip":
        return _octets(v)
    if kind == "card":
        return F.length(d).between(16, 19) & F.call_function("luhn_check", d)
    if kind == "phone":
        return F.length(d).between(8, 15)
    return F.lit(True)


def _loose_kind(v: Column) -> Column:
    like = lambda r: F.regexp_like(v, F.lit(r))
    return (
        F.when(like(r"[\[(]at[\])]"), "email").when(like(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "identity").when(like(r"^\(?[0-9]{3}\)?[ .-]"), "phone")
        .when(like(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), "account").when(like(r"^[0-9]{13,19}$"), "card").otherwise("secret")
    )


def _iban_ok(v: Column) -> Column:
    """ISO 7064 mod 97 of an account number."""
    turned = F.split(F.concat(F.substring(v, 5, 40), F.left(v, F.lit(4))), "")
    digit = lambda c: F.ascii(c) - F.when(F.ascii(c) >= 65, 55).otherwise(48)
    rest = F.aggregate(turned, F.lit(0), lambda acc, c: F.when(F.length(c) == 0, acc).otherwise((acc * F.when(F.ascii(c) >= 65, 100).otherwise(10) + digit(c)) % 97))
    return rest == 1


def _ballot(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 0).otherwise(-1)


def _judged(x: Column, kind: Column) -> Column:
    """A looser candidate with its votes and its features."""
    v, d, before = x["value"], _digits(x["value"]), x["before"]
    like = lambda c, r: F.regexp_like(c, F.lit(r))
    share = F.length(d) * 4 / F.length(v)
    card, secret, email, phone = (kind == k for k in ("card", "secret", "email", "phone"))
    strict = _ballot(kind.isin("identity", "account", "phone", "email") | card & like(d, _ISSUERS) | secret & like(before, "[=:] *[\"']?$"), card)
    gazetteer = _ballot(email & like(v, _HOSTS) | phone & like(d, "^[2-9]") | secret & like(v, _KEYS), email | phone)
    context = _ballot(like(before, _YES), like(before, _NO))
    mixed = like(v, "[A-Z]") & like(v, "[a-z]") & like(v, "[0-9]")
    shape = _ballot(secret & mixed & (share >= 0.4), (F.length(d) > 3) & like(d, r"^(.)\1*$") | secret & ~mixed & ~like(v, "^(?:[0-9a-f]+|[0-9A-F]+)$") & (share < 0.6))
    check = F.when(card, F.when(F.call_function("luhn_check", d), 1).otherwise(0)).when(kind == "account", F.when(_iban_ok(v), 1).otherwise(0))
    check = check.when(kind == "identity", F.when(like(v, "^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"), 1).otherwise(0)).otherwise(-1)
    after = _ballot(like(x["after"], _THEN_YES), like(x["after"], _THEN_NO))
    distinct = F.size(F.array_distinct(F.split(v, "")))
    variety = _ballot(secret & mixed & (distinct >= 12), card & (distinct < 4) | secret & (distinct < 8))
    plain = _ballot(F.lit(False), secret & like(v, "[a-z]{4,}[_-][a-z]{4,}"))
    more = F.array(after, variety, plain).alias("more")
    return F.struct(
        kind.alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), F.lit(False).alias("base"), F.array(strict, gazetteer, context, shape, check).alias("votes"), more,
        F.array(kind, F.least(F.floor(F.log2(F.length(v))), F.lit(8)).cast("string"), F.least(F.floor(share), F.lit(4)).cast("string"), context.cast("string"), check.cast("string")).alias("features"),
    )


def candidates(docs: DataFrame) -> DataFrame:
    """(_row, _pii): the rows of ``docs`` and the candidates of each text: base matches, and looser ones apart from them."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    text = F.coalesce(F.col("_row.text"), F.lit(""))
    cols = {}
    for kind in [*BASE, "loose"]:
        cols[f"m_{kind}"], cols[f"p_{kind}"] = _matches(text, kind)
    found = rows.withColumns(cols)

    def strict(kind: str) -> Column:
        valid = F.filter(_placed(f"m_{kind}", f"p_{kind}"), lambda x: _base_ok(kind, x["value"]))
        none = F.array().cast("array<int>").alias("votes"), F.array().cast("array<int>").alias("more"), F.array().cast("array<string>").alias("features")
        return F.transform(valid, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), F.lit(True).alias("base"), *none))

    found = found.withColumn("base", F.concat(*map(strict, BASE))).withColumn("loose", _placed("m_loose", "p_loose"))
    apart = F.filter("loose", lambda x: ~F.exists("base", lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"])))
    return found.select("_row", F.concat("base", F.transform(apart, lambda x: _judged(x, _loose_kind(x["value"])))).alias("_pii"))


_K = len(LABELERS)
START = ((0.4, 0.1, 0.5), (0.4, 0.4, 0.2))  # chances that a labeler abstains, says no, says yes: on real spans, on false ones
_Y, _N = (f"array({', '.join(f'{x}D' for x in row)})" for row in START)
_SUM = "aggregate(e, 0D, (z, c) -> z + c.n * c.{p})"
_LIKE = "transform(sequence(0, {k}), j -> transform(sequence(0, 2), v -> (aggregate(e, 2 * {start}[v], (z, c) -> z + IF(c.votes[j] + 1 = v, c.n * c.{p}, 0D))) / ({total} + 2)))"
#: One EM step in SQL: s has the prior and, for each labeler, the chances of its votes on real and on false spans.
_STEP = f"""
transform(array(transform(transform(cells, c -> struct(c.n as n, c.votes as votes,
    ln(s.prior / (1 - s.prior)) + aggregate(sequence(0, {_K - 1}), 0D, (z, j) -> z + ln(s.yes[j][c.votes[j] + 1] / s.no[j][c.votes[j] + 1])) as odds)),
    c -> struct(c.n as n, c.votes as votes, 1 / (1 + exp(-c.odds)) as p, 1 / (1 + exp(c.odds)) as q))),
  e -> struct(({_SUM.format(p="p")} + 1) / ({_SUM.format(p="p")} + {_SUM.format(p="q")} + 2) as prior,
    {_LIKE.format(k=_K - 1, start=_Y, p="p", total=_SUM.format(p="p"))} as yes, {_LIKE.format(k=_K - 1, start=_N, p="q", total=_SUM.format(p="q"))} as no))[0]
"""
_LEAN = "aggregate(s.{p}, 0D, (z, x) -> z + x[2] - x[1])"


def reliabilities(cells: DataFrame, rounds: int = 40) -> DataFrame:
    """One row (prior, yes[][], no[][]) from ``cells(votes, n)`` by expectation-maximisation; the vote v has index v + 1."""
    start = f"struct(0.5D as prior, array_repeat({_Y}, {_K}) as yes, array_repeat({_N}, {_K}) as no)"
    one = cells.select(F.struct(F.col("n").cast("double").alias("n"), "votes").alias("c")).agg(F.sort_array(F.collect_list("c")).alias("cells"))
    done = one.select(F.expr(f"aggregate(sequence(1, {rounds}), {start}, (s, i) -> {_STEP})").alias("s"))
    turned = f"IF({_LEAN.format(p='yes')} >= {_LEAN.format(p='no')}, s, struct(1 - s.prior as prior, s.no as yes, s.yes as no))"
    return done.select(F.expr(turned).alias("s")).select("s.*")


def classifier(found: DataFrame) -> DataFrame:
    """One row: ``w``, a map from feature slot and value to its log likelihood ratio, and ``prior``."""
    each = found.select(F.explode("_pii").alias("c")).where("not c.base").groupBy("c.votes", "c.features").agg(F.count(F.lit(1)).cast("double").alias("n"))
    each = stored(each, "votes")  # few rows: votes and features have few values, whatever the input
    em = reliabilities(each.groupBy("votes").agg(F.sum("n").alias("n")))
    logit = F.expr(f"ln(prior / (1 - prior)) + aggregate(sequence(0, {_K - 1}), 0D, (z, j) -> z + ln(yes[j][votes[j] + 1] / no[j][votes[j] + 1]))")
    soft = each.join(F.broadcast(em)).select("features", "n", (1 / (1 + F.exp(-logit))).alias("p"))  # em is one row
    by = soft.select(F.posexplode("features").alias("slot", "value"), "n", "p").groupBy("slot", "value").agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no"))
    total = soft.agg(F.coalesce(F.sum(F.col("n") * F.col("p")), F.lit(0.0)).alias("all_yes"), F.coalesce(F.sum(F.col("n") * (1 - F.col("p"))), F.lit(0.0)).alias("all_no"))
    ratio = F.log((F.col("yes") + 0.5) / (F.col("all_yes") + 2.5)) - F.log((F.col("no") + 0.5) / (F.col("all_no") + 2.5))
    entry = F.struct(F.concat_ws("=", F.col("slot").cast("string"), "value").alias("key"), ratio.alias("value"))
    weights = by.join(F.broadcast(total)).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("w"))
    prior = total.select(F.log((F.col("all_yes") + 1) / (F.col("all_no") + 1)).alias("prior"))
    return weights.join(F.broadcast(prior))


#: By labeler: how often it says no on a real span, and yes on a false one, of the times it votes.
KNOWN = {"strict": (0.1, 0.4), "gazetteer": (0.1, 0.3), "context": (0.1, 0.2), "shape": (0.1, 0.3), "checksum": (0.01, 0.1), "after": (0.1, 0.2), "variety": (0.1, 0.3), "plain": (0.1, 0.3)}
PRIOR = 0.4  # without any vote, a candidate is no span
_MISS, _WRONG = (f"array({', '.join(f'{x[i]}D' for x in KNOWN.values())})" for i in (0, 1))
_ODDS = "ln(s.prior / (1 - s.prior)) + aggregate(sequence(0, {last}), 0D, (z, j) -> z + CASE {votes}[j] WHEN 1 THEN ln((1 - s.miss[j]) / s.wrong[j]) WHEN 0 THEN ln(s.miss[j] / (1 - s.wrong[j])) ELSE 0D END)"
_RATE = "transform(sequence(0, {last}), j -> (total * {known}[j] + aggregate(e, 0D, (z, c) -> z + IF(c.votes[j] = {vote}, c.n * c.{p}, 0D))) / (total + aggregate(e, 0D, (z, c) -> z + IF(c.votes[j] >= 0, c.n * c.{p}, 0D))))"
_LAST = len(KNOWN) - 1
#: One EM step inside a kind: s has the prior and, by labeler, the chances of a missed and of a wrong vote.
_KIND_STEP = f"""
transform(array(transform(transform(cells, c -> struct(c.n as n, c.votes as votes, {_ODDS.format(last=_LAST, votes="c.votes")} as odds)),
    c -> struct(c.n as n, c.votes as votes, 1 / (1 + exp(-c.odds)) as p, 1 / (1 + exp(c.odds)) as q))),
  e -> struct((total * {PRIOR}D + {_SUM.format(p="p")}) / (2 * total) as prior,
    {_RATE.format(last=_LAST, known=_MISS, vote=0, p="p")} as miss, {_RATE.format(last=_LAST, known=_WRONG, vote=1, p="q")} as wrong))[0]
"""


def kind_reliabilities(cells: DataFrame, rounds: int = 40) -> DataFrame:
    """One row a kind (kind, s: prior, miss[], wrong[]) from ``cells(kind, votes, n)``; at most 3 ** 8 patterns a kind are gathered."""
    one = cells.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct(F.col("n").cast("double").alias("n"), "votes"))).alias("cells"), F.sum(F.col("n").cast("double")).alias("total"))
    start = f"struct({PRIOR}D as prior, {_MISS} as miss, {_WRONG} as wrong)"
    return one.select("kind", F.expr(f"aggregate(sequence(1, {rounds}), {start}, (s, i) -> {_KIND_STEP})").alias("s"))


def _signals(votes: Column, features: Column) -> Column:
    """What the classifier of a kind sees: length, digit share, and every vote."""
    return F.concat(F.slice(features, 2, 2), F.transform(votes, lambda v: v.cast("string")))


def kind_classifier(found: DataFrame) -> DataFrame:
    """One row, as of ``classifier``, learned inside each kind: ``w`` from (kind, slot, value), and the kind alone, to
    log ratios; a value's smoothing is its share in the kind, so what all candidates of a kind have in common is neutral."""
    c = found.select(F.explode("_pii").alias("c")).where("not c.base")
    each = c.select("c.kind", F.concat("c.votes", "c.more").alias("votes"), "c.features").groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).cast("double").alias("n"))
    each = stored(each, "votes")  # few rows: kinds, votes and features have few values, whatever the input
    em = kind_reliabilities(each.groupBy("kind", "votes").agg(F.sum("n").alias("n")))
    soft = each.join(F.broadcast(em), "kind")  # a row a kind
    soft = soft.select("kind", _signals(F.col("votes"), F.col("features")).alias("f"), "n", F.expr(f"1 / (1 + exp(-({_ODDS.format(last=_LAST, votes='votes')})))").alias("p"))
    yes, no = F.sum(F.col("n") * F.col("p")), F.sum(F.col("n") * (1 - F.col("p")))
    total = soft.groupBy("kind").agg(yes.alias("all_yes"), no.alias("all_no"))
    by = soft.select("kind", F.posexplode("f").alias("slot", "value"), "n", "p").groupBy("kind", "slot", "value").agg(yes.alias("yes"), no.alias("no")).join(F.broadcast(total), "kind")
    whole = F.col("all_yes") + F.col("all_no")
    share = (F.col("yes") + F.col("no")) / whole
    ratio = F.log((F.col("yes") + share) / (F.col("all_yes") + 1)) - F.log((F.col("no") + share) / (F.col("all_no") + 1))
    prior = F.log((whole * PRIOR + F.col("all_yes")) / (whole * (1 - PRIOR) + F.col("all_no")))
    entry = lambda key, value: F.struct(key.alias("key"), value.alias("value"))
    entries = by.select(entry(F.concat_ws("=", "kind", F.col("slot").cast("string"), "value"), ratio).alias("e")).union(total.select(entry(F.col("kind"), prior).alias("e")))
    return entries.agg(F.map_from_entries(F.sort_array(F.collect_list("e"))).alias("w"))


def decided(found: DataFrame, by_kind: bool = False) -> DataFrame:
    """(_row, _pii_spans) of stored ``candidates``: base matches and what the classifier accepts, (rank, start,
    stop, kind, base) sorted by kind and start."""
    scored = found.join(F.broadcast((kind_classifier if by_kind else classifier)(found)))  # one row
    weight = lambda *key: F.coalesce(F.col("w")[F.concat_ws("=", *key)], F.lit(0.0))
    if by_kind:
        odds = lambda c: F.aggregate(F.transform(_signals(F.concat(c["votes"], c["more"]), c["features"]), lambda f, i: weight(c["kind"], i.cast("string"), f)), weight(c["kind"]), lambda z, x: z + x)
    else:
        odds = lambda c: F.aggregate(F.transform(c["features"], lambda f, i: weight(i.cast("string"), f)), F.col("prior"), lambda z, x: z + x)
    kept = F.filter("_pii", lambda c: c["base"] | (odds(c) >= 0))
    rank = lambda k: F.array_position(F.lit(KINDS), k).cast("int")
    spans = F.transform(kept, lambda c: F.struct(rank(c["kind"]).alias("rank"), c["start"].alias("start"), c["stop"].alias("stop"), c["kind"].alias("kind"), c["base"].alias("base")))
    return scored.select("_row", F.array_sort(spans).alias("_pii_spans"))


def find(docs: DataFrame, by_kind: bool = False) -> DataFrame:
    """``docs`` with ``_pii_spans``."""
    return decided(stored(candidates(docs), "candidates"), by_kind).select("_row.*", "_pii_spans")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in angle brackets; of overlapping spans, the union goes."""
    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    cut = lambda a, b: F.substring(text, a + 1, F.greatest(b - a, F.lit(0)))
    folded = F.aggregate(
        by_place, zero,
        lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(s["stop"].alias("at"), F.concat(acc["out"], F.array(cut(acc["at"], s["start"]), F.concat(F.lit("<"), s["kind"], F.lit(">")))).alias("out")))
        .otherwise(F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, folded).otherwise(text)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    found = candidates(documents(spark, sf_dir).select("doc_id", "text"))
    short = found.select(F.struct("_row.doc_id").alias("_row"), "_pii")  # texts are not stored again
    found = decided(stored(short, "candidates"), by_kind=True)
    s = F.col("_pii_spans")
    base = F.filter(s, lambda x: x["base"])
    many = [F.size(F.array_remove(F.transform(base, lambda x: x["kind"] == F.lit(k)), False)).cast("long").alias(f"n_{k}") for k in BASE]  # noqa: B023
    return found.select("_row.doc_id", *many, F.sha2(joined(base), 256).alias("base_sha256"), joined(s).alias("spans"))
