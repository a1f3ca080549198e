"""Personal data by candidate gradient boosting [DataFrame functions only].

The base spans of four kinds are exact patterns with checks. On top of them generators of high
recall propose overlapping spans (a number inside a longer run of numbers, a national phone
number, an email address in words); boosted trees judge each by its format and its context, and
a candidate whose score reaches its kind's calibrated threshold becomes a span unless it overlaps
a base span or a better candidate.

The trees are fitted on the driver, on a fixed number of invented examples (TRAIN of each kind),
and are a constant array that an aggregate expression goes through. Groups are repeated possessively or a bounded number of times, so
that very long runs can't exhaust a thread's stack, and no run is entered twice.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

#: Where a run is entered only at its start, or where the last match ended.
_LOCAL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++"
BASE = {
    "email": _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a whole run of digits with single separators, if it has 12 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
GENERATORS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63}){1,4}"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
    ("card", r"(?<![0-9])3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5}(?![0-9])"),
    ("phone", r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2}(?![0-9])"),
    ("phone", r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){3}(?![0-9])"),
    ("phone", r"(?<![0-9+(.-])(?<![0-9+][ -])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9.-])"),
)
_IP = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"
_WORDS = r"(?i)(?:card|visa|master|amex|credit|phone|tel|call|mobile|fax|mail|contact|reach)[^0-9A-Za-z]{0,3}\z"
CONTEXT = 24


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value bound to a variable, so that it is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _running(steps: Column) -> Column:
    """Running sums of an array of longs, by blocks: about n * 256 steps, not n * n."""
    n = 256
    div = lambda i: F.floor(i / n).cast("int")
    return _let(
        steps,
        lambda s: _let(
            F.transform(F.sequence(F.lit(0), div(F.size(s) - 1)), lambda b: _sum(F.slice(s, b * n + 1, n))),
            lambda blocks: _let(
                F.transform(blocks, lambda _, b: _sum(F.slice(blocks, F.lit(1), b))),
                lambda before: F.transform(s, lambda _, i: F.get(before, div(i)) + _sum(F.slice(s, div(i) * n + 1, i % n + 1))),
            ),
        ),
    )


_FOUND = "array<struct<start:bigint,body:string>>"


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, body>>: the non-overlapping matches from the left; code points."""
    p = F.lit(pattern)

    def placed(m: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), lambda x, i: F.length(x).cast("long") + F.coalesce(F.length(F.get(m, i - 1)), F.lit(0)))
        return F.when(F.size(m) > 0, F.zip_with(_running(gaps), m, lambda start, body: F.struct(start.alias("start"), body.alias("body")))).otherwise(F.array().cast(_FOUND))

    return _let(F.regexp_extract_all(text, p, F.lit(0)), placed)


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    doubled = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    digit = lambda r, i: F.substring(r, i, F.lit(1)).cast("int")
    total = _let(
        F.reverse(digits),
        lambda r: F.aggregate(F.sequence(F.lit(1), F.length(r)), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, F.get(doubled, digit(r, i))).otherwise(digit(r, i))),
    )
    return total % 10 == 0


_CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda body: F.lit(True),
    "ip": lambda body: body.rlike(_IP),
    "card": lambda body: _let(_digits(body), _luhn),
    "phone": lambda body: F.length(_digits(body)).between(9, 15),
}
_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"
#: What a text has in it wherever it has a match.
_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
#: What a text has in it wherever a pattern or a generator has a match: most texts have none.
ANY = r"@|\+[0-9]|at[\])]|[0-9]\.[0-9]+\.[0-9]|[0-9](?:[ .()-]{0,2}[0-9]){6}"


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end>> of the base spans, in order (kind: its place in KINDS)."""

    def of(k: int, kind: str) -> Column:
        ok = F.filter(_matches(text, BASE[kind]), lambda m: _CHECKS[kind](m["body"]))
        spans = F.transform(ok, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), (m["start"] + F.length(m["body"])).alias("end")))
        return F.when(text.rlike(_HINTS[kind]), spans).otherwise(F.array().cast(_SPANS))

    return F.array_sort(F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)]))


# --- candidates -------------------------------------------------------------------------------

FEATURES = ("kind", "digits", "luhn", "plus", "separators", "before", "after", "first", "distinct", "word", "length")


def _features(kind: Column, body: Column, before: Column, after: Column) -> list[Column]:
    """FEATURES; before and after: up to CONTEXT characters on either side."""
    digits = _digits(body)
    near = F.regexp_replace(before, r"[\s\x{22}'(:=]+\z", "")
    return [
        kind,
        F.length(digits),
        F.when(F.length(digits) > 0, F.when(_luhn(digits), 1).otherwise(0)).otherwise(0),
        F.when(body.startswith("+"), 1).otherwise(0),
        F.length(F.regexp_replace(body, "[^ ().-]", "")),
        F.when(before.rlike(r"[A-Za-z0-9_]\z"), 1).otherwise(0),
        F.when(after.rlike("^[A-Za-z0-9_]"), 1).otherwise(0),
        F.when(F.length(digits) > 0, F.substring(digits, 1, 1).cast("int")).otherwise(-1),
        F.size(F.array_distinct(F.split(digits, ""))),
        F.when(near.rlike(_WORDS), 1).otherwise(0),
        F.length(body),
    ]


def features(kind: int, body: str, before: str, after: str) -> list[float]:
    """The same features, for fitting."""
    digits = re.sub("[^0-9]", "", body)
    total = sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
    near = re.sub(r"[\s\x22'(:=]+\Z", "", before)
    return [
        kind,
        len(digits),
        int(bool(digits) and total % 10 == 0),
        int(body.startswith("+")),
        len(re.sub("[^ ().-]", "", body)),
        int(bool(re.search(r"[A-Za-z0-9_]\Z", before))),
        int(bool(re.match("[A-Za-z0-9_]", after))),
        int(digits[0]) if digits else -1,
        max(1, len(set(digits))),
        int(bool(re.search(_WORDS.replace(r"\z", r"\Z"), near))),
        len(body),
    ]


def _card(rng: random.Random, n: int, valid: bool) -> str:
    body = [rng.choice("3456") if valid else rng.choice("0123456789"), *(rng.choice("0123456789") for _ in range(n - 2))]
    total = sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
    right = -total % 10
    return "".join(body) + str(right if valid else (right + rng.randrange(1, 10)) % 10)


#: Invented examples of each kind, half of them no personal data.
TRAIN = 1500


def _examples(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = random.Random(seed)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9)))
    x, y = [], []

    def add(kind: str, body: str, good: bool, before: str | None = None, after: str | None = None) -> None:
        words = f"{w()} {w()} {rng.choice(['', '', 'phone ', 'tel: ', 'card: ', 'call ', 'mail '] if good else ['', '', 'no. ', 'id='])}"
        x.append(features(KINDS.index(kind), body, words if before is None else before, rng.choice([" ", ". ", ", ", "\n", ""]) if after is None else after))
        y.append(good)

    for _ in range(TRAIN // 2):
        n = rng.choice([13, 14, 15, 16, 16, 16, 16, 19])
        card = _card(rng, n, True)
        sep = rng.choice(["", "", " ", "-"]) if n == 16 else ""
        add("card", sep.join(card[i : i + 4] for i in range(0, n, 4)), True, before=rng.choice([None, None, f"{d(3)} ", f"{d(3)}-{d(4)} "]))
        kind = rng.randrange(3)
        bad = [_card(rng, rng.choice([13, 14, 16, 16, 19]), False), rng.choice("012789") + d(rng.choice([12, 15, 18])), _card(rng, 16, True)][kind]
        add("card", bad, False, before=f"{w()} {rng.choice('abcdef')}" if kind == 2 else None, after=rng.choice("abcdef") if kind == 2 else None)
        body = rng.choice([f"+{rng.randrange(1, 99)} ({d(3)}) {d(3)}-{d(4)}", f"+{rng.randrange(1, 99)}-{d(3)}-{d(3)}-{d(4)}", f"+{rng.randrange(1, 99)} {d(3)} {d(3)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}"])
        add("phone", body, True, after=rng.choice([None, None, f" {d(16)}"]))
        bad = rng.choice([f"+{d(2)}{d(2)}{d(2)}", f"+{d(1)} {d(2)} {d(2)} {d(2)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{d(3)}{d(4)}{d(4)}{d(4)}"])
        add("phone", bad, False, before=rng.choice([None, f"{w()}=", f"{d(2)}"]), after=rng.choice([None, rng.choice("abcdef")]))
        add("email", f"{w()} [at] {w()} [dot] {w()}", True)
        add("email", f"{w()}(at){w()}.{w()}", True)
        add("email", f"{w()[:2]} (at){d(2)}.{d(1)}", False, before=f"{w()} ", after=rng.choice("abc") + w())
    return np.array(x, dtype=float), np.array(y, dtype=float)


@dataclass
class Tree:
    """Two levels: (feature, cut) of the root and of its sides (None: no cut), and four leaves."""

    cuts: list[tuple[int, float] | None]
    leaves: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        side = lambda c: x[:, c[0]] > c[1] if c else np.zeros(len(x), dtype=bool)
        root, low, high = (side(c) for c in self.cuts)
        return np.array(self.leaves)[np.where(root, 2 + high, low)]

    def sql(self) -> str:
        """A struct of the tree; a cut that is missing is never passed."""
        cuts = [(c[0], f"{c[1]!r}D") if c else (0, "double('inf')") for c in self.cuts]
        told = zip("abc", "pqr", cuts, strict=True)
        return f"named_struct({', '.join(f'{x!r}, {j}, {y!r}, {v}' for x, y, (j, v) in told)}, {', '.join(f'{n!r}, {v!r}D' for n, v in zip('wxyz', self.leaves, strict=True))})"


@dataclass
class Model:
    bias: float
    trees: list[Tree]
    thresholds: list[float]  # of KINDS, in log-odds

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum(t.score(x) for t in self.trees)

    def column(self, f: Column) -> Column:
        """The score of an array of features: the trees are a constant that the scan goes through."""
        side = lambda t, j, cut, left, right: F.when(F.get(f, t[j]) > t[cut], right).otherwise(left)
        tree = lambda t: side(t, "a", "p", side(t, "b", "q", t["w"], t["x"]), side(t, "c", "r", t["y"], t["z"]))
        return F.aggregate(F.expr(f"array({', '.join(t.sql() for t in self.trees)})"), F.lit(self.bias), lambda a, t: a + tree(t))


ROUNDS, RATE = 24, 0.4


@lru_cache(maxsize=1)
def fitted() -> Model:
    """The trees, and for each kind the lowest threshold with at most one wrong acceptance in a
    hundred among examples that weren't fitted on."""
    x, y = _examples()
    held = np.arange(len(y)) % 4 == 0
    fx, fy = x[~held], y[~held]
    model = Model(float(np.log(fy.mean() / (1 - fy.mean()))), [], [])
    z = np.full(len(fy), model.bias)
    cuts = [(j, float(c)) for j in range(x.shape[1]) for c in (lambda v: (v[:-1] + v[1:]) / 2)(np.unique(fx[:, j]))]

    def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float] | None:
        gains = []
        for j, c in cuts:
            right = rows & (fx[:, j] > c)
            left = rows & ~right
            gains.append(sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, right) if s.any()))
        k = int(np.argmax(gains))
        return cuts[k] if gains[k] > g[rows].sum() ** 2 / (h[rows].sum() + 1) + 1e-6 else None

    for _ in range(ROUNDS):
        s = 1 / (1 + np.exp(-z))
        g, h = fy - s, s * (1 - s)
        everything = np.ones(len(fy), dtype=bool)
        root = best(everything, g, h)
        right = fx[:, root[0]] > root[1] if root else ~everything
        found: list[tuple[int, float] | None] = [root]
        leaves = []
        for side in (~right, right):
            cut = best(side, g, h) if side.any() else None
            over = side & (fx[:, cut[0]] > cut[1]) if cut else np.zeros(len(fy), dtype=bool)
            found.append(cut)
            leaves += [RATE * g[v].sum() / (h[v].sum() + 1) for v in (side & ~over, over)]
        tree = Tree(found, [float(round(v, 6)) for v in leaves])
        model.trees.append(tree)
        z += tree.score(fx)
    hz, hx, hy = model.score(x[held]), x[held], y[held]
    for k in range(len(KINDS)):
        own, good = hz[hx[:, 0] == k], hy[hx[:, 0] == k]
        ok = [t for t in np.unique(own) if (good[own >= t] == 0).mean() <= 0.01] if len(own) else []
        model.thresholds.append(float(max(min(ok), 0.0)) if ok else float("inf"))
    return model


def candidates(text: Column, model: Model) -> Column:
    """array<struct<score, start, kind, end>> of those that reach their kind's threshold."""

    def of(kind: str, pattern: str) -> Column:
        ready = text.contains("at]") | text.contains("at)") if kind == "email" else text.rlike("[0-9]{2}")
        own = F.transform(_matches(text, pattern), lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["body"].alias("body")))
        return F.when(ready, own).otherwise(F.array().cast("array<struct<start:bigint,kind:int,body:string>>"))

    def judged(m: Column) -> Column:
        start, end = m["start"], m["start"] + F.length(m["body"])
        before = F.substring(text, F.greatest(start - CONTEXT, F.lit(0)).cast("int") + 1, F.least(start, F.lit(CONTEXT)).cast("int"))
        after = F.substring(text, end.cast("int") + 1, F.lit(1))
        made = F.array(*[c.cast("double") for c in _features(m["kind"], m["body"], before, after)])
        return F.struct(_let(made, model.column).alias("score"), start.alias("start"), m["kind"].alias("kind"), end.alias("end"))

    least = F.array(*[F.lit(t) for t in model.thresholds])
    scored = F.transform(F.concat(*[of(*g) for g in GENERATORS]), judged)
    return F.filter(scored, lambda c: c["score"] >= F.get(least, c["kind"]))


_HELD = "array<struct<start:bigint,end:bigint,kind:int,rank:double>>"


def _clusters(held: Column) -> Column:
    """Sorted spans in runs that overlap, so that spans are only compared with those near them."""
    empty = F.struct(F.array().cast(f"array<{_HELD}>").alias("done"), F.array().cast(_HELD).alias("open"), F.lit(0).cast("long").alias("reach"))

    def add(a: Column, s: Column) -> Column:
        apart = (F.size(a["open"]) > 0) & (s["start"] >= a["reach"])
        done = F.when(apart, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"])
        own = F.when(apart, F.array(s)).otherwise(F.concat(a["open"], F.array(s)))
        return F.struct(done.alias("done"), own.alias("open"), F.greatest(a["reach"], s["end"]).alias("reach"))

    return F.aggregate(held, empty, add, lambda a: F.concat(a["done"], F.array(a["open"])))


def all_spans(text: Column, base: Column, model: Model) -> Column:
    """The base spans with the candidates chosen, best first, that overlap nothing chosen."""
    over = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    plain = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    with_rank = lambda s, rank: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), rank.cast("double").alias("rank"))

    def choose(cluster: Column) -> Column:
        sure = F.transform(F.filter(cluster, lambda s: s["rank"].isNull()), plain)
        maybe = F.array_sort(F.transform(F.filter(cluster, lambda s: s["rank"].isNotNull()), lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
        best = F.aggregate(maybe, sure, lambda a, c: F.when(F.exists(a, lambda b: over(b, c)), a).otherwise(F.concat(a, F.array(plain(c)))))
        return F.when(F.size(cluster) == 1, F.transform(cluster, plain)).otherwise(best)

    def together(found: Column) -> Column:
        held = F.concat(F.transform(base, lambda s: with_rank(s, F.lit(None))), F.array_distinct(F.transform(found, lambda c: with_rank(c, -c["score"]))))
        return _let(_clusters(F.array_sort(held)), lambda runs: F.array_sort(F.flatten(F.transform(runs, choose))))

    return _let(candidates(text, model), lambda found: F.when(F.size(found) > 0, together(found)).otherwise(base))


def _named(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row, no shuffle.

    The counts are of base spans. Null texts count as empty; repeated rows get equal results; an
    empty table gives no rows; other columns are not looked at."""
    model = fitted()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    body = F.col("text")
    both = _let(base_spans(body), lambda base: F.struct(base.alias("base"), all_spans(body, base, model).alias("spans")))
    none = F.array().cast(_SPANS)
    both = F.when(body.rlike(ANY), both).otherwise(F.struct(none.alias("base"), none.alias("spans")))
    rows = rows.select("doc_id", both.alias("found")).select("doc_id", F.col("found.base").alias("base"), F.col("found.spans").alias("spans"))

    def count(k: int, kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{kind}")

    counts = [count(k, kind) for k, kind in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(_named(F.col("base")), 256).alias("base_sha256"), _named(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of `text` replaced by its kind in brackets; spans that overlap are
    replaced together, by the first one's kind. Nulls stay null; all columns are kept."""
    model = fitted()
    body = F.col(f"`{text}`").cast("string")

    def merged(spans: Column) -> Column:
        """Overlapping ones joined: spans are sorted by start."""
        last = lambda a: F.element_at(a, -1)
        longer = lambda a, s: F.struct(last(a)["start"].alias("start"), last(a)["kind"].alias("kind"), F.greatest(last(a)["end"], s["end"]).alias("end"))
        joined = lambda a, s: F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(longer(a, s)))
        return F.aggregate(spans, F.array().cast(_SPANS), lambda a, s: F.when((F.size(a) > 0) & (last(a)["end"] > s["start"]), joined(a, s)).otherwise(F.concat(a, F.array(s))))

    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def replaced(spans: Column) -> Column:
        def part(s: Column, i: Column) -> Column:
            since = F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)).cast("int")
            return F.concat(F.substring(body, since + 1, s["start"].cast("int") - since), F.get(names, s["kind"]))

        rest = F.substring(body, F.element_at(spans, -1)["end"].cast("int") + 1, F.length(body))
        return F.when(F.size(spans) > 0, F.concat(F.array_join(F.transform(spans, part), ""), rest)).otherwise(body)

    new = _let(base_spans(body), lambda base: _let(merged(all_spans(body, base, model)), replaced))
    return docs.withColumn(text, F.when(body.rlike(ANY), new).otherwise(body))
