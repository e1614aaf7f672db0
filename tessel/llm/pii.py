r"""Personal data by candidate gradient boosting [native].

Base detectors give exact spans of four kinds. High-recall generators propose further, looser spans (written-out or spaced
addresses, IPv6, card-shaped numbers in any grouping, national phone formats, and values that may be secrets), which may
overlap each other and the base; boosted trees over format and context features score each candidate, a calibrated
threshold per kind selects, and of overlapping ones the best goes first. Everything on a text is a DataFrame expression of
its own row: no shuffle, no Python. The trees are fitted on the driver to a bounded generated sample (TRAIN_ROWS texts)
whose features come from the same expressions; true and false candidates there share formats and differ by context.

Spans are in code points, ends exclusive. Null and empty texts have none; repeated rows and null ids each get their row;
an empty table gives an empty result; other columns may have any name and only `redact` returns them. A very long text is
read once for each pattern whose characters it has: patterns are possessive and start only where a run starts or the last
match ended, which finds the same matches in linear time and constant stack. Ties: spans that start together stand in the
order of KINDS; of candidates with equal scores the one that starts first goes first.
"""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import documents, text_only

KINDS = ("email", "ip", "card", "phone")
#: Kinds of candidates: the base ones, and values of keys and tokens.
ALL = (*KINDS, "secret")
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?: ?[\[({<] ?(?i:at) ?[\])}>] ?| (?i:at) | ?@ ?)", r"(?: ?[\[({<] ?(?i:dot) ?[\])}>] ?| (?i:dot) | ?\. ?)"
LOOSE = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{2,63}}+){{1,4}}+",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}(?:[ ._/-]?[0-9]{4}){2}[ ._/-]?[0-9]{1,7}+|3[47][0-9]{2}[ ._/-]?[0-9]{6}[ ._/-]?[0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+(.-])(?:00[1-9][0-9]{0,2}[ .-]?)?(?:\(0?[0-9]{2,4}\)[ .-]?|0?[0-9]{2,4}[ ./-])[0-9]{3,4}(?:[ .-]?[0-9]{2,5}){1,2}+(?![0-9])",
    "secret": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]{0,40}[0-9])[A-Za-z0-9+/_=-]{20,}+",
}
#: What a text must have to be searched for a pattern, cheaper than the pattern.
_GATE = {
    "base_email": r"@", "base_ip": r"[0-9]\.[0-9]", "base_card": r"[0-9]", "base_phone": r"\+[0-9]",
    "loose_email": r"@|(?i:[\[({< ]at[\])}> ])", "loose_ip": r":[0-9A-Fa-f]{0,4}:", "loose_card": r"[0-9]{4}", "loose_phone": r"[0-9]{2}[ ./)-]", "loose_secret": r"[A-Za-z0-9+/_=-]{20}",
}
#: Stands before and after a match while a text is cut; a text's own is read as the other.
_MARK, _OTHER = "\u0001", "\u0002"
#: Code points on either side of a candidate that its context features see.
CONTEXT = 24
TRAIN_ROWS, SEED = 2400, 5
_HINTS = {
    "email": r"(?i)(?:mail|contact|write|reach|ask)",
    "ip": r"(?i)(?:\bip|addr|host|server|from|client)",
    "card": r"(?i)(?:card|visa|master|amex|pay|account)",
    "phone": r"(?i)(?:tel|phone|call|mobile|fax|dial)",
    "secret": r"(?i)(?:token|secret|passw|key|credential|auth|bearer)",
}
_AGAINST = r"(?i)(?:version|build|order|invoice|isbn|ticket|part|serial|mac|time|sku|ref|commit|sha|md5|hash|file|path|http|look)"


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _block_sums(lengths: str) -> Column:
    """Sums of blocks of 64 lengths; with the sums before each block, running sums need no quadratic work."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / 64).cast("int")), lambda b: _sum(F.slice(lengths, b * 64 + 1, F.lit(64))))


def _sums_before(blocks: str) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(blocks)), lambda b: _sum(F.slice(blocks, F.lit(1), b)))


def _matches(df: DataFrame, patterns: dict[str, str], tag: str) -> DataFrame:
    """For each kind an array of (start, end, text, before, after) of the pattern's leftmost non-overlapping matches.

    A pattern reads a text once, and marks its matches; the text cut at the marks is gaps and matches in turn, whose
    lengths add up to positions.
    """
    kinds = list(patterns)
    empty = F.array().cast("array<string>")

    def parts(k: str) -> Column:
        marked = F.regexp_replace(F.translate("text", _MARK, _OTHER), F.lit(patterns[k]), F.lit(f"{_MARK}$0{_MARK}"))
        return F.when(F.col("text").rlike(_GATE[f"{tag}_{k}"]), F.split(marked, _MARK, -1)).otherwise(empty)

    df = df.withColumns({f"p_{k}": parts(k) for k in kinds})
    df = df.withColumns({f"l_{k}": F.transform(f"p_{k}", lambda p: F.length(p).cast("long")) for k in kinds})
    df = df.withColumns({f"b_{k}": _block_sums(f"l_{k}") for k in kinds})
    df = df.withColumns({f"c_{k}": _sums_before(f"b_{k}") for k in kinds})

    # a slice copies its whole array, so the parts are cut into blocks first, each with its first match's neighbour
    def blocks(k: str) -> Column:
        own = lambda b, n: F.slice(f"p_{k}", b * 64 + 1, F.lit(n))
        one = lambda c, b: F.struct(own(b, 65).alias("p"), F.transform(own(b, 64), lambda x: F.length(x).cast("long")).alias("l"), c.alias("c"))
        return F.when(F.size(f"p_{k}") >= 3, F.transform(f"c_{k}", one))

    df = df.withColumns({f"d_{k}": blocks(k) for k in kinds})

    def spans(k: str) -> Column:
        def one(d: Column, i: Column) -> Column:
            start, text = d["c"] + _sum(F.slice(d["l"], F.lit(1), i)), F.element_at(d["p"], i + 1)
            return F.struct(start.alias("start"), (start + F.length(text)).alias("end"), text.alias("text"), F.right(F.element_at(d["p"], i), F.lit(CONTEXT)).alias("before"), F.left(F.element_at(d["p"], i + 2), F.lit(CONTEXT)).alias("after"))

        none = F.array().cast("array<struct<start:long,end:long,text:string,before:string,after:string>>")
        matches = F.transform(f"d_{k}", lambda d: F.when(F.size(d["p"]) < 3, none).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(d["p"]) - 2, F.lit(1)), F.lit(2)), lambda i: one(d, i))))
        return F.coalesce(F.flatten(matches), none)

    df = df.withColumns({f"{tag}_{k}": spans(k) for k in kinds})
    return df.drop(*(f"{x}_{k}" for x in "plbcd" for k in kinds))


def _digits(s: Column) -> Column:
    return F.translate(s, " -().+_/", "")


def _holds(kind: str, s: Column) -> Column:
    n = F.length(_digits(s))
    if kind == "ip":
        # a part of more than three digits without its leading zeros is over 255
        return ~F.exists(F.split(s, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) > 3) | (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 4).try_cast("int"), F.lit(0)) > 255))
    if kind == "card":
        return n.between(12, 19) & _luhn(_digits(s))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def with_base(df: DataFrame) -> DataFrame:
    """df (text) with base_<kind>: arrays of its base spans."""
    df = _matches(df, BASE, "base")

    def holding(kind: str) -> Column:
        return F.filter(f"base_{kind}", lambda x: _holds(kind, x["text"]))

    return df.withColumns({f"base_{k}": holding(k) for k in KINDS if k != "email"})


def features(kind: str, c: Column) -> dict[str, Column]:
    """Numbers that the trees see: format of the candidate, and context."""
    text, before, after = c["text"], c["before"], c["after"]
    digits = F.length(F.regexp_replace(text, r"[^0-9]", ""))
    hit = lambda p, s: s.rlike(p).cast("int")
    return {
        "length": F.length(text),
        "digits": digits,
        "letters": F.length(F.regexp_replace(text, r"[^A-Za-z]", "")),
        "breaks": F.length(F.regexp_replace(text, r"[^ ._/:-]", "")),
        "brackets": hit(r"[\[({<]", text),
        "luhn": F.coalesce(_luhn(F.regexp_replace(text, r"[^0-9]", "")), F.lit(False)).cast("int"),
        "groups": F.size(F.split(text, r"[ ._/:-]")),
        "written": hit(r"(?i)(?<![A-Za-z])dot(?![A-Za-z])", text),
        "spaced": hit(r"[a-z]\. [A-Z]", text),
        "nought": hit(r"^\(?0", text),
        "mixed": F.size(F.split(text, r"(?<=[0-9])(?=[A-Za-z])")),
        "hex": hit(r"^[0-9A-Fa-f]+$", text),
        "hint": hit(_HINTS[kind], before),
        "against": hit(_AGAINST, before),
        "assigned": hit(r"[=:] ?[\x22']?$", before),
        "glued_before": hit(r"[\w#/.-]$", before),
        "glued_after": hit(r"^[\w#=:/-]", after),
        "after_break": hit(r"^(?:[\s.,;)\x22']|$)", after),
    }


NAMES = ("length", "digits", "letters", "breaks", "brackets", "luhn", "groups", "written", "spaced", "nought", "mixed", "hex", "hint", "against", "assigned", "glued_before", "glued_after", "after_break")


def _sample(rows: int, seed: int) -> list[tuple[int, str, str, int]]:
    """Generated (id, text, kind, label): personal data in formats of each kind, and look-alikes of it."""
    rng = random.Random(seed)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    h = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    w = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8)))
    b = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))

    def card(n: int = 16) -> str:
        body = rng.choice("345") + d(n - 2)
        return next(body + c for c in "0123456789" if sum(sum(divmod(int(x) * (1 + (i % 2)), 10)) for i, x in enumerate(reversed(body + c))) % 10 == 0)

    def grouped(x: str) -> str:
        sep = rng.choice(["", "", " ", "-", ".", "_", "/"])
        if len(x) == 15:
            return sep.join((x[:4], x[4:10], x[10:]))
        return sep.join(x[i : i + 4] for i in range(0, len(x), 4))

    def address() -> str:
        at, dot = rng.choice([(" (at) ", " (dot) "), ("[at]", "."), (" {at} ", " {dot} "), (" at ", " dot "), ("<at>", "<dot>"), (" @ ", " . "), ("@", "@")])
        end = rng.choice(["com", "org", "net", "co"])
        return f"{w()}{rng.choice(['', d(2), '.' + w()])}{at}{w()}{dot if dot != '@' else ' . '}{end}"

    def six() -> str:
        return rng.choice([":".join(h(4) for _ in range(8)), f"fe80::{h(rng.randint(1, 4))}", f"2001:db8::{h(4)}:{h(2)}", f"{h(4)}:{h(4)}::{h(3)}"])

    def phone() -> str:
        return rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"00{rng.randint(1, 99)} {d(3)} {d(3)} {d(4)}", f"0{d(3)} {d(7)}", f"0{d(2)}/{d(4)} {d(3)}", f"({d(4)}) {d(3)} {d(4)}"])

    def secret() -> str:
        return rng.choice([h(40), h(32), h(40).upper(), h(64), "sk-" + b(32), "AKIA" + b(16).upper(), b(24), b(44) + "=", "ghp_" + b(36)])

    quote = lambda x: rng.choice([f'"{x}"', x, f"'{x}'"])
    near = {"email": ["mail me:", "contact", "write to", "ask"], "ip": ["client ip", "host", "from", "server"], "card": ["card", "visa", "paid with", "account"], "phone": ["call", "phone:", "tel", "mobile"]}
    far = ["order", "serial", "ticket", "ref", "invoice", "part", "isbn"]
    good = {
        "email": lambda: (rng.choice([*near["email"], w(), w()]), address()),
        "ip": lambda: (rng.choice([*near["ip"], w()]), six()),
        "card": lambda: (rng.choice([*near["card"], w(), w(), w()]), grouped(rng.choice([card(), card(), card(15), d(16)]))),
        "phone": lambda: (rng.choice([*near["phone"], w()]), phone()),
        "secret": lambda: (rng.choice(["token =", "api_key:", "secret=", "password =", "TOKEN =", "Authorization: Bearer", f"{w()} key ="]), quote(secret())),
    }
    bad = {
        "email": lambda: (rng.choice([w(), "build", "look"]), rng.choice([f"{w()} at {w()}. {w().title()}", f"{w()} at {w()}.{w()}", f"look at {w()}. {w()}", f"{w()} @ {w()}. {w().title()} {w()}"])),
        "ip": lambda: (rng.choice(["time", "mac", "at", w()]), rng.choice([f"{d(2)}:{d(2)}:{d(2)}", ":".join(h(2) for _ in range(6)), f"{d(1)}:{d(2)}:{d(2)}", f"{w()[:2]}::{w()[:3]}"])),
        "card": lambda: (rng.choice(far), grouped(d(16))) if rng.random() < 0.6 else (w(), rng.choice([d(13), d(18), grouped(d(19)), f"{w()}{d(16)}", f"{d(4)}-{d(4)}-{d(4)}-{d(1)}"])),
        "phone": lambda: (rng.choice([*far, w()]), rng.choice([f"{d(3)}{rng.choice('.-')}{d(3)}{rng.choice('.-')}{d(4)}", f"{d(4)}-{d(4)}-{d(3)}", f"20{d(2)} {d(3)} {d(3)}"])) if rng.random() < 0.7 else (w(), f"20{d(2)}-{d(4)}-{d(4)}"),
        "secret": lambda: (rng.choice(["commit", "sha", "file", "path", "http:", w(), "md5"]), rng.choice([h(40), f"{w()}-{w()}-{d(4)}-{w()}-{w()}", f"/{w()}/{w()}{d(1)}/{w()}-{w()}/{w()}", f"{h(8)}-{h(4)}-{h(4)}-{h(4)}-{h(12)}", d(24), f"{w()}_{w()}_{w()}_{d(2)}_{w()}"])),
    }
    out = []
    for i in range(rows):
        kind, label = ALL[i % len(ALL)], i // len(ALL) % 2
        before, core = (good if label else bad)[kind]()
        out.append((i, f"{w()} {before} {core}{rng.choice(['.', ' ', ', ', '', '!!', '###'])} {w()}", kind, label))
    return out


def _tree(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int):
    """A regression tree on gradients: (feature, threshold, left, right) or a leaf's value."""
    total, weight = grad.sum(), hess.sum()
    best = (1e-6, None, None)
    if depth:
        for j in range(x.shape[1]):
            for cut in np.unique(x[:, j])[1:]:
                left = x[:, j] < cut
                g, h = grad[left].sum(), hess[left].sum()
                gain = g * g / (h + 1) + (total - g) ** 2 / (weight - h + 1) - total * total / (weight + 1)
                if gain > best[0]:
                    best = (gain, j, cut)
    if best[1] is None:
        return float(total / (weight + 1))
    left = x[:, best[1]] < best[2]
    return (best[1], float(best[2]), _tree(x[left], grad[left], hess[left], depth - 1), _tree(x[~left], grad[~left], hess[~left], depth - 1))


def _leaf(tree, row: np.ndarray) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
    return tree


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = 16, depth: int = 2, rate: float = 0.4) -> list:
    """Logistic gradient boosting."""
    score, trees = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        trees.append(_tree(x, y - p, p * (1 - p), depth))
        score += rate * np.array([_leaf(trees[-1], row) for row in x])
    return trees


def threshold(score: np.ndarray, y: np.ndarray, precision: float = 0.97) -> float:
    """The lowest score on held-out rows at and above which so many candidates are right."""
    order = np.argsort(-score, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.flatnonzero((right >= precision) & np.append(np.diff(score[order]) != 0, True))
    return float(score[order][last[-1]]) if len(last) else float("inf")


_MODEL: dict[str, tuple[list, float]] = {}


def model(spark) -> dict[str, tuple[list, float]]:
    """Trees and threshold of each kind, fitted once in a session to TRAIN_ROWS generated texts."""
    if not _MODEL:
        made = _sample(TRAIN_ROWS, SEED)
        texts = spark.createDataFrame([(i, t) for i, t, _, _ in made], "id long, text string").coalesce(1)
        found = _matches(texts, LOOSE, "loose")

        def numbers(kind: str) -> Column:
            return F.transform(f"loose_{kind}", lambda c: F.array(*(v.cast("double") for v in features(kind, c).values()))).alias(kind)

        rows = found.select("id", *map(numbers, ALL)).collect()
        truth = {i: (k, y) for i, _, k, y in made}
        for kind in ALL:
            x, y = [], []
            for row in rows:
                for c in row[kind]:
                    x.append(list(c))
                    y.append(truth[row["id"]][1] if truth[row["id"]][0] == kind else 0)
            x, y = np.array(x), np.array(y, float)
            fit = np.arange(len(y)) % 3 != 0
            trees = boosted(x[fit], y[fit])
            held = 0.4 * sum(np.array([_leaf(t, r) for r in x[~fit]]) for t in trees)
            _MODEL[kind] = (trees, threshold(held, y[~fit]))
    return _MODEL


def _scored(trees: list, values: dict[str, Column]) -> Column:
    names = list(values)

    def one(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(0.4 * tree)
        return F.when(values[names[tree[0]]] < F.lit(tree[1]), one(tree[2])).otherwise(one(tree[3]))

    return reduce(lambda a, b: a + b, map(one, trees))


def _place(s: Column, kind: str) -> list[Column]:
    return [s["start"].alias("start"), F.lit(ALL.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")]


#: Code points of a block of a text that is redacted.
BLOCK = 1024
SPAN = "struct<start:long,end:long,base:boolean,loss:double,rank:int,kind:string>"


def let(value: Column, body) -> Column:
    """body of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def in_groups(spans: Column) -> Column:
    """Spans (sorted by start) in groups: those of one group meet each other by a chain, and no span of another group.

    A group begins where no span before reaches; the farthest end before a span comes from blocks, as an aggregate that
    carries an array copies it at every step.
    """
    size = 64
    last = lambda xs: F.coalesce(F.array_max(xs), F.lit(-1).cast("long"))
    ends = lambda xs: F.transform(xs, lambda x: x["end"])
    block = lambda s, b: F.slice(s, b * size + 1, F.lit(size))
    far = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / size).cast("int")), lambda b: last(ends(block(s, b))))

    def firsts(s: Column, most: Column) -> Column:
        before = F.transform(most, lambda m, b: F.struct(block(s, b).alias("own"), last(F.slice(most, F.lit(1), b)).alias("end")))
        begins = lambda d, x, i: x["start"] >= F.greatest(d["end"], last(ends(F.slice(d["own"], F.lit(1), i))))
        return F.flatten(F.transform(before, lambda d, b: F.array_compact(F.transform(d["own"], lambda x, i: F.when(begins(d, x, i), b * size + i + 1)))))

    cut = lambda s, g: F.transform(g, lambda a, k: F.slice(s, a, F.coalesce(F.try_element_at(g, k + 2), F.size(s) + 1) - a))
    return F.when(F.size(spans) > 0, let(spans, lambda s: let(let(far(s), lambda most: firsts(s, most)), lambda g: cut(s, g))))


def _greedy(group: Column) -> Column:
    """Of a group the candidates, best first, that meet no base span and no better one that is taken."""
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    base = F.filter(group, lambda s: s["base"])
    free = F.filter(group, lambda s: ~s["base"] & ~F.exists(base, lambda b: meets(b, s)))
    ranked = F.array_sort(F.transform(free, lambda s: F.struct(s["loss"].alias("loss"), s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    none = F.array().cast("array<struct<loss:double,start:long,rank:int,end:long,kind:string>>")
    return F.aggregate(ranked, none, lambda got, c: F.when(F.exists(got, lambda g: meets(g, c)), got).otherwise(F.concat(got, F.array(c))))


def chosen(candidates: Column, base: Column) -> Column:
    """Candidates (score, start, rank, end, kind), best first, that meet no base span and no better one that is chosen.

    Only spans that meet by a chain can rule each other out, so each such group is settled by itself.
    """
    span = lambda s, own, loss: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"), F.lit(own).alias("base"), loss.alias("loss"), s["rank"].alias("rank"), s["kind"].alias("kind")).cast(SPAN)
    spans = F.concat(F.transform(base, lambda b: span(b, True, F.lit(0.0))), F.transform(candidates, lambda c: span(c, False, -c["score"])))
    return F.flatten(F.transform(in_groups(F.array_sort(spans)), _greedy))


def find(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, text, base spans and all spans (arrays by start, then kind) of each row, and more columns of docs."""
    fitted = model(docs.sparkSession)
    df = _matches(with_base(text_only(docs, *more)), LOOSE, "loose")

    def placed(k: str) -> Column:
        return F.transform(f"base_{k}", lambda s: F.struct(*_place(s, k)))

    def described(k: str) -> Column:
        return F.transform(f"loose_{k}", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.struct(*(v.alias(n) for n, v in features(k, c).items())).alias("x")))

    def scored(k: str) -> Column:
        return F.transform(f"loose_{k}", lambda c: F.struct(*_place(c, k), (_scored(fitted[k][0], {n: c["x"][n] for n in NAMES}) - F.lit(fitted[k][1])).alias("score")))

    def selected(k: str) -> Column:
        return F.filter(f"loose_{k}", lambda c: c["score"] >= 0)

    df = df.withColumn("base", F.array_sort(F.concat(*(placed(k) for k in KINDS))))
    for stage in (described, scored, selected):  # features once for each candidate, then the trees over them
        df = df.withColumns({f"loose_{k}": stage(k) for k in ALL})
    df = df.withColumn("chosen", F.concat(*(f"loose_{k}" for k in ALL)))
    df = df.withColumn("chosen", F.when(F.size("chosen") > 0, chosen(F.col("chosen"), F.col("base"))))
    added = F.transform(F.coalesce("chosen", F.array().cast("array<struct<loss:double,start:long,rank:int,end:long,kind:string>>")), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    rest = df.columns[2 : 2 + len(more)]
    return df.select("doc_id", "text", *rest, "base", F.array_sort(F.concat("base", added)).alias("spans"), *(F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def merged(spans: Column) -> Column:
    """Spans (by start) with overlapping ones as one, of the kind of the first."""
    return F.transform(in_groups(spans), lambda g: F.struct(g[0]["start"].alias("start"), F.array_max(F.transform(g, lambda s: s["end"])).alias("end"), g[0]["kind"].alias("kind")))


def redacted(df: DataFrame, name: str) -> DataFrame:
    """df (text, spans) with a column of the text in which each span, overlapping ones as one, is <kind> of its first.

    The text is cut into blocks, of which the parts between spans are made: a slice or a substring reads all that is before it.
    """
    some = F.size("spans") > 0
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / BLOCK).cast("int")), lambda b: F.col("text").substr(b * BLOCK + 1, F.lit(BLOCK)))
    df = df.withColumn("_cut", F.when(some, merged(F.col("spans")))).withColumn("_blocks", F.when(some, blocks))

    def between(a: Column, z: Column) -> Column:
        """Code points a to z of the text, z not included."""
        i, j = F.floor(a / BLOCK).cast("int"), F.floor(z / BLOCK).cast("int")
        first, last = F.element_at("_blocks", i + 1), F.element_at("_blocks", j + 1)
        from_ = (a - i * BLOCK + 1).cast("int")
        return F.when(i == j, first.substr(from_, (z - a).cast("int"))).otherwise(F.concat(first.substr(from_, F.lit(BLOCK)), F.array_join(F.slice("_blocks", i + 2, F.greatest(j - i - 1, F.lit(0))), ""), last.substr(F.lit(1), (z - j * BLOCK).cast("int"))))

    def piece(s: Column, i: Column) -> Column:
        since = F.when(i > 0, F.element_at("_cut", F.greatest(i, F.lit(1)))["end"]).otherwise(0)
        return F.concat(between(since, s["start"]), F.lit("<"), s["kind"], F.lit(">"))

    tail = between(F.element_at("_cut", -1)["end"], F.length("text"))
    clean = F.when(some, F.concat(F.array_join(F.transform("_cut", piece), ""), tail)).otherwise(F.col("text"))
    return df.withColumn(name, clean).drop("_cut", "_blocks")


def redact(docs: DataFrame) -> DataFrame:
    """The rows of docs with all their columns, personal data in text replaced (and n_chars, if there, counted anew)."""
    found = redacted(find(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")), "_clean")
    clean = F.when(F.col("_row.text").isNotNull(), F.col("_clean"))
    new = {"text": clean, "n_chars": F.length(clean).cast("long")}
    return found.select(*(new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def op5_boosted_pii(spark, sf_dir):
    found = find(documents(spark, sf_dir))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"), F.size("spans").cast("long").alias("n_spans"))
