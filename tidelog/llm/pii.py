"""Operator 10 [native]: personal data by weakly supervised span labelling.

Regular expressions give base spans (e-mail, IP, card, phone) and looser candidates (numbers, opaque
strings). Labelers vote on each of them: patterns, gazetteers (top-level domains, card issuers, calling
codes) and the words just before. Expectation-maximisation over the counts of vote patterns in the whole
corpus estimates how reliable each labeler is; the resulting soft labels train a span classifier, which
decides on the candidates. Base spans always stay.

Everything that touches rows is DataFrame functions inside the row: matches, places, votes and, in a second
reading of what was found, decisions and redaction. Only counts of vote patterns are exchanged; the driver sees
them, at most 6 kinds * 3 lengths * 3**4 votes, however large the corpus is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.arrays import bind, blocks, running
from tidelog.llm.scratch import materialise

#: Kinds in the order in which spans that start together are listed. The first four are the base.
KINDS = ("email", "ip", "card", "phone", "number", "secret")
#: Leftmost matches as the plain patterns have them; possessive, and begun only where a match can begin, so
#: that long runs of digits or word characters cost no more than their length.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "number": r"(?<![0-9A-Za-z])[0-9][0-9\x20().-]{5,}[0-9](?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+",
}
#: What a text must hold for a pattern to be tried.
HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+", "number": "", "secret": ""}
# Gazetteers and context words.
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "info", "biz", "de", "fr", "es", "it", "uk", "eu", "us", "ca", "ch", "at", "nl", "be")
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"
CALLING = r"^(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
NEAR_YES = r"\b(?:e-?mail|mail|tel|telephone|phone|fax|mobile|cell|call|contact|whatsapp|card|visa|mastercard|amex|credit|iban|account|ssn|passport|ip|host|address|token|secret|key|apikey|password|passwd|telefon|handy|karte|konto|adresse|courriel|téléphone|carte|compte|correo|teléfono|tarjeta|cuenta)\b"
NEAR_NO = r"\b(?:version|license|licence|section|chapter|page|figure|table|volume|isbn|issn|doi|year|article|kapitel|seite|jahr|chapitre|année|capítulo|página|año)\b"
CONTEXT = 40
#: Put around matches to cut them out; a text that holds it is cut by other means.
MARK = "\ufdd0"
LABELERS = ("pattern", "gazetteer", "context", "shape")
ONE = f"struct<start:bigint,nth:int,kind:string,end:bigint,valid:boolean,long:int,{','.join(f'{v}:int' for v in LABELERS)}>"
FOUND = f"array<{ONE}>"
SPAN = "struct<start:bigint,nth:int,kind:string,end:bigint>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    """Whether a string of digits passes; counted from the right, every second digit doubled."""
    each = F.transform(
        F.sequence(F.lit(1), F.length(d)),
        lambda i: F.substring(d, i, F.lit(1)).cast("int") * (((F.length(d) - i) % 2) + 1),
    )
    return F.aggregate(each, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    d = _digits(match)
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
    return (
        F.when(kind == "ip", match.rlike(rf"\A{part}\.{part}\.{part}\.{part}\z"))
        .when(kind == "card", F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False)))
        .when(kind == "phone", F.length(d).between(9, 15))
        .otherwise(F.lit(True))
    )


def _votes(kind: Column, match: Column, before: Column, valid: Column) -> dict[str, Column]:
    """+1: personal, -1: not, 0: no opinion; for each labeler."""
    d = _digits(match)
    different = F.size(F.array_distinct(F.split(match, "")))
    return {
        "pattern": F.when(kind.isin(*KINDS[:4]), F.when(valid, 1).otherwise(-1))
        .when(kind == "number", F.when(F.length(d).between(9, 19), 1).when(F.length(d) < 8, -1).otherwise(0))
        .otherwise(F.when(match.rlike(r"\A[0-9a-fA-F]{32,}\z"), 1).when(~match.rlike("[0-9]"), -1).otherwise(0)),
        "gazetteer": F.when(kind == "email", F.when(F.lower(F.substring_index(match, ".", -1)).isin(*DOMAINS), 1).otherwise(0))
        .when(kind == "ip", F.when(match.rlike(r"\A0*(?:0|127|255)\."), -1).otherwise(1))
        .when(kind == "phone", F.when(d.rlike(CALLING), 1).otherwise(-1))
        .when(kind.isin("card", "number"), F.when(d.rlike(ISSUERS), 1).otherwise(0))
        .otherwise(F.lit(0)),
        "context": F.when(before.rlike(NEAR_YES), 1).when(before.rlike(NEAR_NO), -1).otherwise(0),
        "shape": F.when(match.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z|\A[0-9]+(?:\.[0-9]+){1,2}\z"), -1)
        .when(kind == "secret", F.when(different >= 10, 1).when(different <= 5, -1).otherwise(0))
        .when(kind.isin("card", "number"), F.when(F.size(F.array_distinct(F.split(d, ""))) <= 3, -1).otherwise(0))
        .otherwise(F.lit(0)),
    }


def _parts(kind: str, text: Column) -> Column:
    """What a text consists of by a kind's pattern: gap, match, gap, match, ..., gap."""
    pattern = PATTERNS[kind]
    marked = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    otherwise = bind(F.struct(gaps.alias("g"), matches.alias("m")), lambda x: F.concat(F.flatten(F.zip_with(F.slice(x["g"], 1, F.size(x["m"])), x["m"], lambda g, m: F.array(g, m))), F.slice(x["g"], -1, 1)))
    apart = F.when(text.contains(MARK), F.when(F.size(matches) > 0, otherwise).otherwise(F.array(text))).otherwise(marked)
    return F.when(text.contains(HINTS[kind]), apart).otherwise(F.array(text)) if HINTS[kind] else apart


def _found(text: Column) -> Column:
    """All kinds' matches as FOUND. A match's place is the length of all gaps and matches before it."""
    kinds = F.array(*map(F.lit, KINDS))

    def of_kind(parts: Column, k: Column) -> Column:
        ends = running(F.transform(parts, lambda p: F.length(p).cast("bigint")), lambda a, b: a + b)
        x = F.struct(parts.alias("parts"), ends.alias("ends"), (k + 1).alias("nth"), F.get(kinds, k).alias("kind"))
        return F.when(F.size(parts) > 1, bind(x, matches)).otherwise(F.array().cast(FOUND))

    def matches(x: Column) -> Column:
        def one(i: Column) -> Column:
            raw = F.struct(F.get(x["ends"], 2 * i).alias("start"), F.get(x["ends"], 2 * i + 1).alias("end"), F.get(x["parts"], 2 * i + 1).alias("match"), F.lower(F.right(F.get(x["parts"], 2 * i), F.lit(CONTEXT))).alias("before"))
            return bind(raw, judged)

        def judged(m: Column) -> Column:
            return bind(F.struct(m["start"].alias("start"), m["end"].alias("end"), m["match"].alias("match"), m["before"].alias("before"), _valid(x["kind"], m["match"]).alias("valid")), voted)

        def voted(m: Column) -> Column:
            size = m["end"] - m["start"]
            length = F.when(size < 12, 0).when(size < 24, 1).otherwise(2)
            votes = _votes(x["kind"], m["match"], m["before"], m["valid"])
            return F.struct(m["start"], x["nth"], x["kind"], m["end"], m["valid"], length, *votes.values()).cast(ONE)

        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x["parts"]) - 3) / 2).cast("int")), one)

    return F.flatten(F.transform(F.array(*[_parts(k, text) for k in KINDS]), of_kind))


def found_in(docs: DataFrame, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the columns of carry as _carry, and found: all matches, with places, validity, votes and size class."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.struct(F.lit(1).alias("_"), *carry).alias("_carry"), _found(text).alias("found"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each match."""
    return found_in(docs, (), id_col, text_col).select("doc_id", F.inline("found"))


@dataclass
class Model:
    reliability: dict[str, list[list[float]]]  # labeler -> [class][vote + 1]
    prior: float
    weights: dict[str, float]


def _features(kind: str, long: int, votes: tuple[int, ...]) -> list[str]:
    return ["bias", f"kind:{kind}", f"long:{long}", *(f"{v}:{x}" for v, x in zip(LABELERS, votes, strict=True) if x)]


def learn(patterns: list[tuple[str, int, tuple[int, ...], int]], rounds: int = 40) -> Model:
    """From (kind, length class, votes, count): EM for the labelers, then a logistic classifier on soft labels."""
    soft = [1 / (1 + math.exp(-1.5 * sum(v))) for _, _, v, _ in patterns]
    total = sum(n for *_, n in patterns)
    prior, table = 0.5, {}
    for _ in range(rounds):
        prior = min(0.99, max(0.01, sum(p * n for p, (*_, n) in zip(soft, patterns, strict=True)) / total))
        table = {}
        for j, name in enumerate(LABELERS):
            sums = [[4.0, 2.0, 1.0], [1.0, 2.0, 4.0]]  # labelers are thought better than chance until counts say otherwise
            for p, (_, _, v, n) in zip(soft, patterns, strict=True):
                sums[0][v[j] + 1] += (1 - p) * n
                sums[1][v[j] + 1] += p * n
            table[name] = [[x / sum(side) for x in side] for side in sums]
        soft = []
        for _, _, v, _ in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(table[name][1][x + 1] / table[name][0][x + 1]) for name, x in zip(LABELERS, v, strict=True))
            soft.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    rows = [(_features(k, long, v), n / total) for k, long, v, n in patterns]
    weights = {f: 0.0 for fs, _ in rows for f in fs}
    for _ in range(300):
        slope = {f: 1e-4 * w for f, w in weights.items()}
        for (fs, n), p in zip(rows, soft, strict=True):
            off = n * (1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[f] for f in fs))))) - p)
            for f in fs:
                slope[f] += off
        for f, s in slope.items():
            weights[f] -= 2.0 * s
    return Model(table, prior, weights)


def fit(found: DataFrame) -> Model | None:
    """found: a row for each match."""
    rows = found.groupBy("kind", "long", *LABELERS).count().collect()
    patterns = sorted((r["kind"], r["long"], tuple(r[v] for v in LABELERS), r["count"]) for r in rows)
    return learn(patterns) if patterns else None


def _chance(model: Model) -> str:
    """SQL for the classifier's chance that the match m is personal."""
    terms = [repr(model.weights.get("bias", 0.0))]
    for f, w in model.weights.items():
        name, _, value = f.partition(":")
        if value:
            terms.append(f"CASE WHEN m.{name} = {repr(value) if name == 'kind' else int(value)} THEN {w!r}D ELSE 0D END")
    return f"1 / (1 + exp(-({' + '.join(terms)})))"


def _free(base: Column, loose: Column) -> Column:
    """Spans of loose that meet none of base. All base spans that begin before a loose one's end are met first
    in the common order, and the farthest end among them says whether one reaches into it."""
    at = lambda flag, by, reach: lambda s: F.struct(s[by].alias("at"), F.lit(flag).alias("flag"), reach(s).alias("reach"), s.alias("span"))
    order = F.array_sort(F.concat(F.transform(loose, at(0, "end", lambda s: F.lit(0).cast("bigint"))), F.transform(base, at(1, "start", lambda s: s["end"]))))

    def kept(order: Column) -> Column:
        reach = running(F.transform(order, lambda x: x["reach"]), F.greatest)
        clear = F.zip_with(order, reach, lambda x, r: F.when((x["flag"] == 0) & (r <= x["span"]["start"]), x["span"]))
        return F.filter(clear, lambda s: s.isNotNull())

    return F.when((F.size(loose) == 0) | (F.size(base) == 0), loose).otherwise(bind(order, kept))


def spans(docs: DataFrame, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: _carry, doc_id, base and added: arrays of (start, nth, kind, end) in order.

    Added spans are candidates that the classifier takes for personal and that meet no base span.
    """
    found = materialise(found_in(docs, carry, id_col, text_col), "spans")
    model = fit(found.select(F.inline("found")))
    first, last = KINDS[:4], KINDS[4:]
    span = "struct(m.start, m.nth, m.kind, m.end)"
    base = F.expr(f"array_sort(transform(filter(found, m -> m.kind IN {first} AND m.valid), m -> {span}))")
    loose = F.expr("slice(array(), 1, 0)" if model is None else f"transform(filter(found, m -> m.kind IN {last} AND {_chance(model)} >= 0.5), m -> {span})").cast(f"array<{SPAN}>")
    both = bind(F.struct(base.alias("base"), loose.alias("loose")), lambda x: F.struct(x["base"].alias("base"), F.array_sort(_free(x["base"], x["loose"])).alias("added")))
    return found.select("doc_id", "_carry", F.inline(F.array(both)))


def _text(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of docs.

    Places are code points, ends exclusive. Null and empty texts have no spans: zeros, the digest of an empty
    list, and an empty string. Rows with equal or null ids, and repeated rows, are looked at each on its own; of
    spans that begin together the kind as listed decides the order; an empty table gives no rows. A text of any
    length is one row; its work grows as its length and as its matches by the power of 1.5. Only the id and text columns are read, whatever the others are named.
    """
    found = spans(docs, (), id_col, text_col)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    both = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *map(count, KINDS[:4]), F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(both).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with the same columns and rows; each span of the text, or run of spans that overlap, is replaced
    by its kind in brackets, as [EMAIL]. Null and empty texts, and texts without spans, stay as they are."""
    found = spans(docs, tuple(f"`{c}`" for c in docs.columns), id_col, text_col)
    text = F.col(f"_carry.`{text_col}`").cast("string")

    def cut(all_: Column) -> Column:
        ends = running(F.transform(all_, lambda s: s["end"]), F.greatest)
        before = F.concat(F.array(F.lit(0).cast("bigint")), ends)
        runs = F.zip_with(all_, F.slice(before, F.lit(1), F.size(all_)), lambda s, b: F.when(s["start"] >= b, F.struct(b.alias("from"), s["start"].alias("to"), s["kind"].alias("kind"))))
        return bind(F.struct(F.filter(runs, lambda r: r.isNotNull()).alias("runs"), F.element_at(ends, -1).alias("end")), pieced)

    def pieced(x: Column) -> Column:
        """Each run's gap before it and its kind. Of a long text a block's part is cut out first."""
        lines = F.flatten(F.transform(blocks(x["runs"]), lambda block: bind(F.struct(block.alias("runs"), part(block[0]["from"], F.element_at(block, -1)["to"]).alias("text"), block[0]["from"].alias("from")), line)))
        return F.concat(F.array_join(lines, ""), part(x["end"], F.lit(1 << 31)))

    def part(start: Column, end: Column) -> Column:
        return F.substring(text, (start + 1).cast("int"), F.least(end - start, F.lit(1 << 30)).cast("int"))

    def line(block: Column) -> Column:
        return F.transform(block["runs"], lambda r: F.concat(F.substring(block["text"], (r["from"] - block["from"] + 1).cast("int"), (r["to"] - r["from"]).cast("int")), F.lit("["), F.upper(r["kind"]), F.lit("]")))

    spans_of = F.array_sort(F.concat("base", "added"))
    new = F.when(F.size("base") + F.size("added") == 0, text).otherwise(bind(spans_of, cut))
    return found.select(*[(new.cast(docs.schema[c].dataType) if c == text_col else F.col(f"_carry.`{c}`")).alias(c) for c in docs.columns])
