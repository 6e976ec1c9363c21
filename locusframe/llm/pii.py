"""Personal data by weak supervision, in DataFrame functions throughout.

Base patterns give the certain spans, wider patterns further candidates outside of them.  For every candidate, base ones
included, a regex, a gazetteer and a context labeler vote for, against or not at all.  Votes are counted over the whole
corpus by (kind, votes, shape) - a table of bounded size - on which expectation-maximisation estimates how reliable
each labeler is, and a logistic span classifier is fitted to the resulting probabilities.  Its weights go back into the
plan as literals; wider candidates that it accepts are added to the base spans, and base spans that it doubts are counted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm import spans as sp
from locusframe.llm.scratch import Scratch

KINDS = ("email", "ip", "card", "phone")
#: Added kinds come after the base ones.
ADDED = ("masked_email", "local_phone", "id_number", "card_part", "person", "street")

# fixed values: gazetteers of common top-level domains, calling codes, given names, cities and street words
TOP_LEVEL = "com|org|net|edu|gov|io|de|fr|es|uk|eu|info|dev|us|ca|au|it|nl|ch|at|be|se|no|pl|br|in|jp"
CALLING = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|52|54|55|56|57|60|61|62|63|64|65|66|81|82|84|86|90|91|351|352|353|358|380|420|971|972"
GIVEN = (
    "James|Mary|Robert|Patricia|John|Jennifer|Michael|Linda|David|Elizabeth|William|Barbara|Richard|Susan|Joseph|Jessica|Thomas|Sarah|Charles|Karen|Christopher|Lisa|Daniel|Nancy|Matthew|Betty|"
    "Anthony|Margaret|Mark|Sandra|Paul|Ashley|Steven|Kimberly|Andrew|Emily|Joshua|Donna|Kevin|Michelle|Brian|Carol|George|Amanda|Edward|Melissa|Peter|Anna|Hans|Maria|Klaus|Ursula|Stefan|Sabine|"
    "Wolfgang|Monika|Andreas|Petra|Jean|Marie|Pierre|Nathalie|Michel|Isabelle|Philippe|Sylvie|Antonio|Carmen|Manuel|Ana|Jose|Laura|Francisco|Isabel|Juan|Pilar|Alice|Bob|Emma|Olivia|Noah|Liam"
)
CITIES = "London|Paris|Berlin|Madrid|Rome|Vienna|York|Chicago|Boston|Hamburg|Munich|Lyon|Barcelona|Seattle|Dallas|Houston|Denver|Miami|Dublin|Zurich|Geneva|Brussels|Amsterdam|Lisbon|Milan"
STREETS = "Street|Avenue|Road|Lane|Drive|Boulevard|Court|Square|Place|Way"
STREETS_SHORT = "St|Ave|Rd|Ln|Dr|Blvd|Ct"
AGAINST = "(?i)\\b(?:version|isbn|issn|order|invoice|ticket|page|section|part|lot|model|serial|build|chapter)\\b"

#: Characters of a value that the regex labeler may vote for.
LONGEST = 320
#: What the labelers look for, by kind: the regex labeler votes for a value that matches and against any other; the
#: gazetteer for or against by two patterns, else by its third entry; the context labeler for by a pattern near the value,
#: against by AGAINST there. Values of emails are read with their full stops, those of cards as digits.
LABELS = {
    "email": ("^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9][A-Za-z0-9-]*\\.)+[A-Za-z]{2,}$", (f"\\.(?i:{TOP_LEVEL})$", "(?i)^(?:no-?reply|example|user|name)@", -1), "(?i)\\b(?:e-?mail|mail|contact|write|reach|address|cc)\\b"),
    "ip": ("^[1-9][0-9]{0,2}(?:\\.(?:0|[1-9][0-9]{0,2})){3}$", ("^(?:[1-9]|1[1-9]|[2-9][0-9]|1[013-689][0-9]|2[01][0-9])\\.", "^(?:0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\\.|^192\\.168\\.", 0), "(?i)\\b(?:ip|host|server|from|login|address|client|by)\\b"),
    "card": ("^(?:[0-9]{15,16})$", ("^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)", "^(.)\\1*$", 0), "(?i)\\b(?:card|visa|mastercard|amex|credit|debit|payment|pay)\\b"),
    "phone": ("^\\+[1-9][0-9]{0,2}[ .(-]", (f"^\\+(?:{CALLING})[^0-9]", "(?:555-01[0-9]{2}|000-?0000)$", 0), "(?i)\\b(?:phone|tel|telephone|call|mobile|cell|fax|contact|dial)\\b"),
    "masked_email": ("^[A-Za-z0-9._%+-]+ ?[\\[({] ?(?i:at) ?[\\])}] ?[A-Za-z0-9-]+ ?[\\[({.]", (f"(?<![A-Za-z])(?i:{TOP_LEVEL})$", "^$", -1), "(?i)\\b(?:e-?mail|mail|contact|write|reach|address)\\b"),
    "local_phone": ("^(?:\\([2-9][0-9]{2}\\) ?|[2-9][0-9]{2}[ .-])[2-9]", ("^$", "^[^0-9]*([0-9])(?:[^0-9]*\\1)*$|555[ .-]01[0-9]{2}$", 0), "(?i)\\b(?:phone|tel|telephone|call|mobile|cell|fax|contact|dial)\\b"),
    "id_number": ("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$", ("^$", "^(?:078-05-1120|219-09-9999|123-45-6789)$", 0), "(?i)\\b(?:ssn|social|security|tax|insurance|passport)\\b"),
    "card_part": ("^(?:[0-9]{15,16})$", ("^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)", "^(.)\\1*$", 0), "(?i)\\b(?:card|visa|mastercard|amex|credit|debit|payment|pay)\\b|[0-9]{13,16}[ -]?$"),
    "person": ("^[A-Z][a-z]{2,11} [A-Z][a-z]{2,14}$", (f"^(?:{GIVEN}) ", "^$", -1), "(?i)\\b(?:mr|mrs|ms|dr|prof|herr|frau|mme|name|named|called|signed|by|from|contact|author|with)\\b"),
    "street": ("^[1-9]|[1-9][0-9]{0,3}$", (f"(?:{STREETS})$|(?:stra\u00dfe|strasse|weg|platz|allee|gasse) ", "^$", 0), f"(?i)\\b(?:address|live|lives|at|located|home|office|ship|deliver)\\b|\\b(?:{CITIES})\\b"),
}

_EMAIL = "(?:\\G|(?<![A-Za-z0-9._%+\\x02-]))[A-Za-z0-9._%+\\x02-]++@[A-Za-z0-9-]++\\x02[A-Za-z0-9\\x02-]*+"
_IP = "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
_CARD = "(?<![0-9\\x02])[0-9\\x02]{2,}+"
_PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
_WIDE = {
    "masked_email": "(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{1,63}\\x20?[\\[({]\\x20?(?i:at)\\x20?[\\])}]\\x20?[A-Za-z0-9-]{1,63}\\x20?(?:\\.|[\\[({]\\x20?(?i:dot)\\x20?[\\])}])\\x20?[A-Za-z]{2,12}(?![A-Za-z])",
    "local_phone": "(?<![0-9A-Za-z+.(-])(?:\\([0-9]{3}\\)\\x20?|[0-9]{3}[\\x20.-])[0-9]{3}[\\x20.-][0-9]{4}(?![0-9A-Za-z.-])",
    "id_number": "(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z.-])",
    "card_part": "(?<![0-9])(?:[0-9]{13,16}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])",
    "person": "(?<![A-Za-z\u00c0-\u017f])[A-Z][a-z]{1,15} [A-Z][a-z]{1,20}(?![A-Za-z\u00c0-\u017f])",
    "street": f"(?<![0-9A-Za-z])[0-9]{{1,5}} (?:[A-Z][a-z]{{1,20}} ){{1,2}}(?:{STREETS}|{STREETS_SHORT})(?![A-Za-z])|[A-Z][a-z\u00e4\u00f6\u00fc\u00df]{{2,20}}(?:stra\u00dfe|strasse|weg|platz|allee|gasse) [0-9]{{1,4}}(?![0-9])",
}


def _marked(text: Column, before: str, mark: str, after: str) -> Column:
    """A copy of equal length in which single characters between others stand as \\x02, so that what may repeat
    in a match is one character class: such patterns run without recursion on texts of any length."""
    return F.regexp_replace(F.translate(text, "\x02", "\x03"), f"(?<={before}){mark}(?={after})", "\x02")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0),
        lambda a, i: a + F.element_at(F.array(*[F.array(*[F.lit(v) for v in row]) for row in ((0, 1, 2, 3, 4, 5, 6, 7, 8, 9), (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))]), ((i + 1) % 2 + 1).cast("int"))[F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")],
    )
    return total % 10 == 0


def _base(text: Column) -> Column:
    """The base spans with the text around them."""
    value = lambda c: c["span"]["value"]
    email = F.when(F.contains(text, F.lit("@")), sp.in_context(_marked(text, "[A-Za-z0-9-]", "\\.", "[A-Za-z0-9-]"), _EMAIL, "email", 0)).otherwise(F.array().cast(sp.IN_CONTEXT))
    ip = F.filter(sp.in_context(text, _IP, "ip", 1), lambda c: F.forall(F.split(value(c), "\\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False))))
    many = F.regexp_like(text, F.lit("[0-9](?:[ -]?[0-9]){13}"))
    card = F.when(many, sp.in_context(_marked(text, "[0-9]", "[ -]", "[0-9]"), _CARD, "card", 2)).otherwise(F.array().cast(sp.IN_CONTEXT))
    card = F.filter(card, lambda c: F.when(F.length(value(c)) <= 40, (F.length(_digits(value(c))).between(14, 19)) & luhn(_digits(value(c)))).otherwise(F.lit(False)))
    phone = F.filter(sp.in_context(text, _PHONE, "phone", 3, probe=F.contains(text, F.lit("+"))), lambda c: F.length(_digits(value(c))).between(10, 15))
    return F.concat(email, ip, card, phone)


def _wide(text: Column) -> Column:
    """The spans of the wider patterns with the text around them."""
    probe = {"masked_email": F.contains(F.lower(text), F.lit("at")), "card_part": F.regexp_like(text, F.lit("[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}"))}
    return F.concat(*[sp.in_context(text, p, k, len(KINDS) + i, probe=probe.get(k)) for i, (k, p) in enumerate(_WIDE.items())])


def _outside(wide: Column, base: Column) -> Column:
    """The candidates of wide that overlap no span of base."""
    ends = lambda f: F.sort_array(F.transform(base, lambda c: c["span"][f]))
    both = F.array(F.struct(ends("start").alias("starts"), ends("end").alias("ends")))  # bound once a row
    free = lambda b: F.filter(wide, lambda c: sp.below(b["starts"], c["span"]["end"]) == sp.below(b["ends"], c["span"]["start"] + 1))
    return F.when((F.size(wide) > 0) & (F.size(base) > 0), F.get(F.transform(both, free), F.lit(0))).otherwise(wide)


def _voted(found: Column) -> Column:
    """Candidates with their votes (1 for, -1 against, 0 none) and shape."""
    any_of = lambda c, f: F.coalesce(*[F.when(c["span"]["kind"] == k, f(k, c)) for k in LABELS], F.lit(0))

    def value(k: str, c: Column) -> Column:
        return _digits(c["span"]["value"]) if k.startswith("card") else F.translate(c["span"]["value"], "\x02", ".") if k == "email" else c["span"]["value"]

    def regex_vote(k: str, c: Column) -> Column:
        # no personal datum of these kinds is longer; the patterns with repeated groups need the bound
        good = F.when(F.length(c["span"]["value"]) <= LONGEST, F.regexp_like(value(k, c), F.lit(LABELS[k][0]))).otherwise(F.lit(False))
        return F.when(good & luhn(value(k, c)) if k == "card_part" else good, 1).otherwise(-1)

    def gazetteer_vote(k: str, c: Column) -> Column:
        good, bad, other = LABELS[k][1]
        return F.when(F.regexp_like(value(k, c), F.lit(bad)), -1).when(F.regexp_like(value(k, c), F.lit(good)), 1).otherwise(other)

    def context_vote(k: str, c: Column) -> Column:
        near = F.concat(c["before"], F.lit("\n"), c["after"]) if k == "street" else c["before"]
        return F.when(F.regexp_like(near, F.lit(LABELS[k][2])), 1).when(F.regexp_like(near, F.lit(AGAINST)), -1).otherwise(0)

    shape = lambda c: F.least(F.length(c["span"]["value"]) / 8, F.lit(4)).cast("int")
    return F.transform(found, lambda c: F.struct(c["span"].alias("span"), any_of(c, regex_vote).alias("regex"), any_of(c, gazetteer_vote).alias("gazetteer"), any_of(c, context_vote).alias("context"), shape(c).alias("shape")))


def reliabilities(table: list[tuple[str, tuple[int, ...], int]], rounds: int = 30) -> dict[str, tuple[float, list[dict[int, tuple[float, float]]]]]:
    """table: (kind, votes, times). For each kind the prior and, for each labeler and vote, its probability if the
    span is personal data and if it is not, by expectation-maximisation; votes count as independent given that.
    Starts from labelers that are right four times in five."""
    out = {}
    for kind in sorted({k for k, _, _ in table}):
        rows = [(v, n) for k, v, n in table if k == kind]
        width = len(rows[0][0])
        prior, rates = 0.5, [{1: (0.7, 0.15), 0: (0.2, 0.2), -1: (0.1, 0.65)} for _ in range(width)]
        for _ in range(rounds):
            total, yes, votes = 0.0, 0.0, [{v: [1.0 * a, 1.0 * b] for v, (a, b) in {1: (0.7, 0.15), 0: (0.2, 0.2), -1: (0.1, 0.65)}.items()} for _ in range(width)]
            for v, n in rows:
                p = posterior(prior, rates, v)
                total, yes = total + n, yes + n * p
                for j, x in enumerate(v):
                    votes[j][x][0] += n * p
                    votes[j][x][1] += n * (1 - p)
            prior = (yes + 1) / (total + 2)
            rates = [{x: (c[0] / sum(y[0] for y in w.values()), c[1] / sum(y[1] for y in w.values())) for x, c in w.items()} for w in votes]
        out[kind] = (prior, rates)
    return out


def posterior(prior: float, rates: list[dict[int, tuple[float, float]]], votes: tuple[int, ...]) -> float:
    yes, no = math.log(prior), math.log(1 - prior)
    for r, v in zip(rates, votes):
        yes, no = yes + math.log(r[v][0]), no + math.log(r[v][1])
    return 1 / (1 + math.exp(max(-700.0, min(700.0, no - yes))))


def features(kind: str, votes: tuple[int, ...], shape: int) -> list[float]:
    return [1.0, *map(float, votes), *(float(kind == k) for k in LABELS), shape / 4]


def classifier(rows: list[tuple[list[float], float, int]], steps: int = 400, rate: float = 0.5, decay: float = 1e-3) -> list[float]:
    """Weights of a logistic model of (features, probability, times), by full-batch gradient steps."""
    total = sum(n for _, _, n in rows)
    w = [0.0] * len(rows[0][0])
    for _ in range(steps):
        slope = [decay * x for x in w]
        for x, p, n in rows:
            e = (1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x)))) - p) * n / total
            for j, v in enumerate(x):
                slope[j] += e * v
        w = [a - rate * g for a, g in zip(w, slope)]
    return w


def _accepts(c: Column, weights: list[float], threshold: float) -> Column:
    kind = c["span"]["kind"]
    x = [F.lit(1.0), c["regex"], c["gazetteer"], c["context"], *[(kind == k).cast("double") for k in LABELS], c["shape"] / 4]
    score = sum((a * F.lit(w) for a, w in zip(x[1:], weights[1:])), x[0] * F.lit(weights[0]))
    return score >= math.log(threshold / (1 - threshold))


def candidates(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """(id, base, wide): base spans and the wider candidates outside of them, with their votes."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = scratch.cut(docs.select(F.col(id_col).alias("id"), _voted(_base(text)).alias("base"), _voted(_wide(text)).alias("wide")), "candidates")
    return rows.select("id", "base", _outside(F.col("wide"), F.col("base")).alias("wide"))


def vote_table(rows: DataFrame) -> list[tuple[str, tuple[int, ...], int, int]]:
    """(kind, votes, shape, times) over all candidates: at most kinds x 27 votes x 5 shapes rows, however many spans there are."""
    each = rows.select(F.explode(F.concat("base", "wide")).alias("c")).select("c.span.kind", "c.regex", "c.gazetteer", "c.context", "c.shape")
    return sorted((r["kind"], (r["regex"], r["gazetteer"], r["context"]), r["shape"], r["count"]) for r in each.groupBy("kind", "regex", "gazetteer", "context", "shape").count().collect())


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, name: str = "pii") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_doubtful) for each row of docs.

    spans holds the base spans (kind:start:end, code points, end exclusive) and those candidates outside of them, in
    kinds of their own, to which the classifier gives threshold or more; n_doubtful counts the base spans to which it gives
    less than a half.  A null text is empty; every row is judged by its own whole text of any length, repeated ids
    included; spans that start together are ordered by kind; what other columns are called plays no part; without
    candidates nothing is fitted; an empty table gives no rows.
    """
    rows = candidates(docs, Scratch(docs.sparkSession, name), id_col, text_col)
    table = vote_table(rows)
    base, added, doubtful = F.transform("base", lambda c: c["span"]), F.array().cast(sp.SPAN), F.lit(0)
    if table:
        trust = reliabilities([(k, v, n) for k, v, _, n in table])
        weights = classifier([(features(k, v, s), posterior(*trust[k], v), n) for k, v, s, n in table])
        added = F.transform(F.filter("wide", lambda c: _accepts(c, weights, threshold)), lambda c: c["span"])
        doubtful = F.size(F.filter("base", lambda c: ~_accepts(c, weights, 0.5)))
    return rows.select(
        F.col("id").alias(id_col), *[sp.count(base, k).alias(f"n_{k}") for k in KINDS], F.sha2(sp.rendered(base), 256).alias("base_sha256"),
        sp.rendered(F.concat(base, added)).alias("spans"), F.size(added).cast("bigint").alias("n_added"), doubtful.cast("bigint").alias("n_doubtful"),
    )
