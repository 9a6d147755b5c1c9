"""Personal data: many candidate spans, scored by boosted trees, selected above calibrated thresholds.

Four base kinds follow fixed patterns and always stay. Looser generators propose
further spans, which may overlap (obfuscated addresses, numbers with other
separators, telephone numbers without a plus sign). Boosted trees score each
proposal from its format and the words around it. They learn from the corpus
itself: base spans rewritten in their text into loose forms are examples;
proposals that overlap a span of another kind, fail the kind's own test, stand
inside a word or fall on a decoy (a domain after "at" without its local part, a
short list, a date, a bare number) are counter-examples. The threshold of each
kind is the lowest score at which labelled proposals that the trees have not seen
reach the wanted precision. What fails its kind's own test is never added.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlift.llm.texts import pick, text_udf

KINDS = ("email", "ip", "card", "phone")
SAMPLE_TEXTS = 3000  # texts, about, by a hash, whose proposals the trees may learn from: a fifth of them for each kind, a fifth of any
SAMPLE_PROPOSALS = 40  # of each version of such a text, at most, as fitting sample
FOLDS = 5  # one in so many texts is never learned from
ROUNDS, DEPTH, RATE, BINS = 40, 3, 0.2, 16
PRECISION = 0.98
STEPS, REACH = 32, 8  # scores are counted in steps of 1/32, those beyond +-8 at the ends

# The patterns of the base kinds. A run of digits is entered at its beginning only.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")

LOOSE = {
    "email": re.compile(r"(?<![\w.])[\w.%+-]{1,64}+(?: ?[\[(]at[\])] ?| at )[\w-]{1,63}+(?:(?: ?[\[(]dot[\])] ?| dot |\.)[\w-]{1,63}+)+"),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,4}+(?:[.,:][0-9]{1,4}+){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[ ./_-]{0,2}[0-9]){11,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+(])[(+]?[0-9](?:[ ()./-]{0,2}[0-9]){6,14}(?![0-9])"),
}
NEAR = {
    "email": re.compile(r"mail|contact|write|schreib|correo|courriel", re.I),
    "ip": re.compile(r"\bip\b|host|server|addr|adress", re.I),
    "card": re.compile(r"card|visa|credit|karte|carte|tarjeta|pay", re.I),
    "phone": re.compile(r"phone|tel|call|fax|mobil|ruf", re.I),
}
CONTEXT = 40
DOT = re.compile(r"[\[(](?:at|dot)[\])]| dot ")  # what marks an obfuscated address
FORMS = 3  # loose forms in which a labelled text is seen


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the base pattern, entered at each @ so that long words cost no more than their length."""
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and LOCAL.match(text[start - 1]):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            last = domain.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four base kinds by start, then kind as listed."""
    found = [("email", s, e) for s, e in emails(text)]
    if any(c in text for c in "0123456789"):
        found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(_small(p) for p in m[0].split("."))]
        for m in CARD.finditer(text):
            d = _digits(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                found.append(("card", m.start(), m.end()))
        found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Loose spans of every kind; they may overlap each other and the base spans."""
    has_digit = any(c in text for c in "0123456789")
    has_at = "at" in text and ("@" in text or " at " in text or "(at" in text or "[at" in text)
    return [(kind, m.start(), m.end()) for kind, p in LOOSE.items() if (has_at if kind == "email" else has_digit) for m in p.finditer(text)]


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a proposal; nothing that only restates a base pattern (plus sign, check digit, values of parts)."""
    span, digits = text[start:end], _digits(text[start:end])
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    parts = [p for p in re.split(r"[^0-9]+", span) if p]
    return [
        float(KINDS.index(kind)), len(span), len(digits), len(span) - len(digits), len(parts), max(map(len, parts), default=0),
        span.count("."), span.count("-"), span.count(" "), span.count("/"), span.count(":"), span.count(","), float("(" in span or "[" in span),
        len(DOT.findall(span)), len(re.split(r" at |[\[( ]", span, maxsplit=1)[0]), float(span[0] == "0"), float(digits[:1] or -1),
        float(before[-1:].isspace() or not before), float(after[:1].isspace() or not after),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(after[:1] in ",;:"),
        *[float(bool(p.search(before))) for p in NEAR.values()], sum(c.isdigit() for c in before), sum(c.isdigit() for c in after),
    ]


def passes(kind: str, span: str) -> bool:
    """The kind's own test, as far as it does not hang on separators: check digit of cards, values of address parts, no time of day as a domain."""
    if kind == "email":
        return not re.split(r"[^\w-]+", span.rstrip(")] "))[-1].isdigit()
    if kind == "card":
        return luhn(_digits(span))
    return kind != "ip" or all(_small(p) for p in re.split(r"[^0-9]+", span) if p)


def loose_forms(kind: str, span: str, form: int) -> list[str]:
    """A base span as people write it to escape the pattern; two strings stand side by side."""
    if kind == "email":
        at, dot = ((" (at) ", "."), (" at ", " dot "), ("[at]", "[dot]"), (" at ", "."), ("(at)", " (dot) "))[form % 5]
        if form % 2 and (at, dot) != (" at ", "."):  # addresses without numbers are marked as well
            span = re.sub(r"(?<=[A-Za-z])[.0-9_+-]*[0-9]+(?=[@.])", "", span)
        local, _, domain = span.partition("@")
        return [local + at + domain.replace(".", dot)]
    if kind == "ip":
        return [span.replace(".", ":,"[form % 2])]
    digits = _digits(span)
    if kind == "card":
        if form % 5 == 4:
            return [digits, digits]
        return [("/", ".", "_", ". ")[form % 5].join(digits[i : i + 4] for i in range(0, len(digits), 4))]
    groups = re.findall(r"[0-9]+", span)
    local = groups[1:] if len(groups) > 1 and len(_digits("".join(groups[1:]))) >= 7 else [digits]
    trunk = [local[0] if local[0][0] == "0" else "0" + local[0], *local[1:]]
    rest = trunk[1:]
    forms = ("00" + span[1:], "/".join(filter(None, [trunk[0], "".join(rest)])), ".".join(trunk), f"({trunk[0]}) {'-'.join(rest)}".strip(), " ".join(trunk), f"{trunk[0]} {'-'.join(rest)}".strip())
    return [forms[form % len(forms)]]


def decoy(kind: str, span: str, form: int) -> str:
    """Something that a loose pattern takes for the kind and that is none."""
    if kind == "email":
        domain = span.partition("@")[2]
        short = ".".join(domain.split(".")[-2:])
        return "at " + (domain, re.sub(r"(?<=[A-Za-z])[0-9]+", "", domain), short, re.sub(r"(?<=[A-Za-z])[0-9]+", "", short))[form % 4]
    if kind == "ip":
        return ":,"[form % 2].join(str(form % 7 + i) for i in range(4))
    if kind == "card":
        return span
    digits = _digits(span)
    n = int(digits)
    date = [f"{1950 + n % 100}", f"{1 + n % 12:02d}", f"{1 + n % 28:02d}"]
    return (digits.lstrip("0") or "1", "-".join(date), ".".join(date[::-1]), "/".join(date))[form % 4]


Region = tuple[str, int, int, bool]


def rewritten(text: str, base: list[tuple[str, int, int]], form: int | None) -> tuple[str, list[Region]]:
    """The text with every base span in a loose form, or as a decoy without a form, and where they stand (True: example)."""
    out: list[str] = []
    regions: list[Region] = []
    at = length = 0
    for i, (kind, start, end) in enumerate(base):
        if start < at or (form is None and kind == "card"):
            continue
        span = text[start:end]
        turn = i + crc32(span.encode())
        out.append(text[at:start])
        length += start - at
        for n, piece in enumerate([decoy(kind, span, turn)] if form is None else loose_forms(kind, span, turn + form)):
            if n:
                out.append(" ")
                length += 1
            out.append(piece)
            regions.append((kind, length, length + len(piece), form is not None))
            length += len(piece)
        at = end
    return "".join([*out, text[at:]]), regions


def label(proposal: tuple[str, int, int], hits: list[Region], text: str) -> int | None:
    """1 example, 0 counter-example, None unknown; ``hits`` are the regions that the proposal touches."""
    kind, start, end = proposal
    if not passes(kind, text[start:end]):
        return 0
    if hits:
        k, s, e, example = hits[0]
        return int(example and len(hits) == 1 and k == kind and abs(s - start) < 2 and abs(e - end) < 2)
    if kind != "email" and (text[max(0, start - 1) : start].isalnum() or text[end : end + 1].isalnum()):
        return 0
    return None


def examples(text: str, most: int | None = None) -> Iterator[tuple[int, list[float]]]:
    """Labelled proposals, at most ``most`` of a kind and version, of a text as it stands, with its base spans in loose forms, and as decoys.

    Base spans as they stand are no examples: what is added later never touches one.
    """
    base = base_spans(text)
    versions = [(text, [(*b, True) for b in base])]
    versions += [rewritten(text, base, form) for form in (*range(FORMS), None)] if base else []
    for v, (body, regions) in enumerate(versions):
        regions.sort(key=lambda r: r[1])
        starts, ends = [r[1] for r in regions], list(accumulate((r[2] for r in regions), max))
        taken = dict.fromkeys(KINDS, 0)
        for p in proposals(body):
            if most is not None and taken[p[0]] >= most:
                continue
            y = label(p, [r for r in regions[bisect_right(ends, p[1]) : bisect_left(starts, p[2])] if r[2] > p[1]], body)
            if y is not None and (v or not y):
                taken[p[0]] += 1
                yield y, describe(body, *p)


@dataclass
class Trees:
    """Boosted regression trees on binned features, with one threshold per kind."""

    edges: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    start: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.edges[j], x[:, j], side="right") for j in range(x.shape[1])], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.margin_of(self.bins(x)) if len(self.trees) else np.full(len(x), self.start)

    def margin_of(self, b: np.ndarray) -> np.ndarray:
        out = np.full(len(b), self.start)
        for feature, cut, value in self.trees:
            node = np.zeros(len(b), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (b[np.arange(len(b)), feature[node]] > cut[node])
            out += value[node - (2**DEPTH - 1)]
        return out


def _grow(b: np.ndarray, gradient: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tree of full depth: per node the best feature and bin to cut at, and each leaf's step."""
    inner = 2**DEPTH - 1
    feature, cut = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)
    node = np.zeros(len(b), np.int64)
    for n in range(inner):
        rows = np.flatnonzero(node == n)
        best = 1e-6
        for j in range(b.shape[1]) if len(rows) > 1 else ():
            g = np.bincount(b[rows, j], gradient[rows], BINS + 1).cumsum()
            h = np.bincount(b[rows, j], weight[rows], BINS + 1).cumsum()
            gain = g**2 / (h + 1) + (g[-1] - g) ** 2 / (h[-1] - h + 1) - g[-1] ** 2 / (h[-1] + 1)
            at = int(gain[:-1].argmax())
            if gain[at] > best:
                best, feature[n], cut[n] = gain[at], j, at
        node[rows] = 2 * n + 1 + (b[rows, feature[n]] > cut[n])
    leaf = node - inner
    g, h = np.bincount(leaf, gradient, inner + 1), np.bincount(leaf, weight, inner + 1)
    value = RATE * g / (h + 1)
    return feature, cut, value, value[leaf]


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees fitted on labelled proposals, without thresholds."""
    model = Trees()
    if len(set(y.tolist())) < 2:
        return model
    model.edges = np.stack([np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]) for j in range(x.shape[1])])
    b = model.bins(x)
    share = y.mean()
    model.start = float(np.log(share / (1 - share)))
    margin = np.full(len(y), model.start)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        feature, cut, value, step = _grow(b, y - p, p * (1 - p))
        model.trees.append((feature, cut, value))
        margin += step
    return model


def steps(margin: np.ndarray) -> np.ndarray:
    """Scores as whole steps from 0 on."""
    return np.clip(np.floor((margin + REACH) * STEPS), 0, 2 * REACH * STEPS - 1).astype(np.int64)


def thresholds(counts: np.ndarray) -> dict[str, float]:
    """From labelled proposals per kind, label and step: the lowest step of an example from which on the precision holds.

    The threshold lies midway to the next lower labelled proposal. However few
    proposals a kind has, they decide: no number of them switches a kind off.
    """
    found = {}
    for kind, (bad, good) in zip(KINDS, counts, strict=True):
        above_good, above_all = good[::-1].cumsum()[::-1], (good + bad)[::-1].cumsum()[::-1]
        passing = np.flatnonzero((good > 0) & (above_good >= PRECISION * above_all))
        if len(passing):
            low = int(passing[0])
            below = np.flatnonzero((good + bad)[:low])
            found[kind] = ((low + below[-1] + 1) / 2 if len(below) else low) / STEPS - REACH
    return found


def added_spans(text: str, base: list[tuple[str, int, int]], model: Trees) -> list[tuple[str, int, int]]:
    """Proposals the model selects that touch no base span; of overlapping ones the best score stays."""
    if not model.thresholds:
        return []
    loose = [p for p in proposals(text) if p[0] in model.thresholds and passes(p[0], text[p[1] : p[2]]) and not any(s < p[2] and p[1] < e for _, s, e in base)]
    if not loose:
        return []
    scores = model.margin(np.array([describe(text, *p) for p in loose], np.float64))
    out: list[tuple[str, int, int]] = []
    ranked = sorted((-s, p) for s, p in zip(scores.tolist(), loose, strict=True) if s >= model.thresholds[p[0]])
    for _, p in ranked:
        if all(p[2] <= s or e <= p[1] for _, s, e in out):
            out.append(p)
    return out


def _write(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _finder(model: Trees) -> Callable[[list[bytes | None]], list[pa.Array]]:
    def find(texts: list[bytes | None]) -> list[pa.Array]:
        counts, bases, spans = [], [], []
        for raw in texts:
            text = raw.decode() if raw else ""
            base = base_spans(text)
            counts.append([sum(k == kind for k, _, _ in base) for kind in KINDS])
            bases.append(_write(base))
            spans.append(_write(sorted(base + added_spans(text, base, model), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))))
        columns = np.array(counts, np.int64).reshape(len(counts), len(KINDS))
        return [*[pa.array(columns[:, i], pa.int64()) for i in range(len(KINDS))], pa.array(bases, pa.string()), pa.array(spans, pa.string())]

    return find


def _base_kinds(texts: list[bytes | None]) -> list[pa.Array]:
    """Bit per kind that has a base span in the text, and one that every text has."""
    masks = [sum(1 << KINDS.index(k) for k in {k for k, _, _ in base_spans(raw.decode() if raw else "")}) for raw in texts]
    return [pa.array([m | 1 << len(KINDS) for m in masks], pa.int32())]


def _examples(texts: list[bytes | None]) -> list[pa.Array]:
    """Labelled proposals of each text, flattened: label, then features."""
    out = []
    for raw in texts:
        rows: list[float] = []
        for y, features in examples(raw.decode() if raw else "", SAMPLE_PROPOSALS // len(KINDS)):
            rows += [float(y), *features]
        out.append(np.array(rows, np.float32).tobytes())
    return [pa.array(out, pa.binary())]


def _judged(model: Trees) -> Callable[[list[bytes | None]], list[pa.Array]]:
    def judge(texts: list[bytes | None]) -> list[pa.Array]:
        """Kind, label and step of every labelled proposal of each text, as one number."""
        out = []
        for raw in texts:
            found = list(examples(raw.decode() if raw else ""))
            if found:
                x = np.array([f for _, f in found], np.float64)
                code = (x[:, 0].astype(np.int64) * 2 + np.array([y for y, _ in found])) * (2 * REACH * STEPS) + steps(model.margin(x))
                out.append(code.astype(np.int32))
            else:
                out.append(np.zeros(0, np.int32))
        return [pa.array(out, pa.list_(pa.int32()))]

    return judge


def learn(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS) -> Trees:
    """Fit on texts by hash, drawn for each kind apart so that rare kinds are seen; calibrate on the labelled proposals of all other texts.

    Numbers come to the driver, no texts: features of the sample, and one count
    per kind, label and step of the score.
    """
    width = 1 + len(describe("0", "ip", 0, 1))
    bits = [F.col("__k.k").bitwiseAND(1 << i) > 0 for i in range(len(KINDS) + 1)]
    marked = docs.where("text RLIKE '[0-9@]'").select("text", F.xxhash64("text").alias("mark"))
    kinds = marked.withColumn("__k", text_udf(_base_kinds, "struct<k:int>", ["k"])(F.col("text")))
    sizes = kinds.select("mark", *[b.alias(f"b{i}") for i, b in enumerate(bits)]).agg(
        *[F.approx_count_distinct(F.when(F.col(f"b{i}"), F.col("mark"))).alias(f"n{i}") for i in range(len(bits))]
    )
    share = max(1, sample_texts // len(bits))
    # A mark is any number of 64 bits: those up to a kind's limit are about its share of texts, however often a text is repeated.
    limits = [min(2**63 - 1, -(2**63) + (share * 2**64) // max(1, n)) for n in sizes.first()]
    drawn = F.lit(False)
    for b, limit in zip(bits, limits, strict=True):
        drawn = drawn | (b & (F.col("mark") <= F.lit(limit)))
    learned = F.pmod("mark", F.lit(FOLDS)) > 0
    chosen = kinds.where(F.col("mark") <= F.lit(max(limits))).where(learned).where(drawn)
    chosen = chosen.select("mark", text_udf(_examples, "struct<x:binary>", ["x"])(F.col("text")).alias("__x")).select("mark", "__x.x")
    rows = chosen.where(F.length("x") > 0).dropDuplicates(["mark"]).orderBy("mark").collect()
    flat = np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(-1, width).astype(np.float64)
    model = fit(flat[:, 1:], flat[:, 0])
    if not model.trees:
        return model
    others = kinds.where(~(learned & drawn)).select(text_udf(_judged(model), "struct<c:array<int>>", ["c"])(F.col("text")).alias("__c"))
    counts = np.zeros((len(KINDS), 2, 2 * REACH * STEPS), np.int64)
    for code, n in others.select(F.explode("__c.c").alias("code")).groupBy("code").count().collect():
        counts.reshape(-1)[code] = n
    model.thresholds = thresholds(counts)
    return model


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_texts: int = SAMPLE_TEXTS) -> DataFrame:
    """One row per document row: n_email, n_ip, n_card, n_phone (base spans), base and spans.

    Spans are written kind:start:end in code points, end exclusive, by start and then
    kind. NULL and empty texts have none. Every row is judged by itself; repeated
    rows, NULL ids and further columns change nothing. Where the sample holds no
    example or no counter-example, only base spans are returned.
    """
    body = pick(docs, doc_id=doc_id, text=text)
    names = [*[f"n_{k}" for k in KINDS], "base", "spans"]
    ddl = "struct<" + ",".join(f"{n}:bigint" for n in names[:4]) + ",base:string,spans:string>"
    rows = body.withColumn("__s", text_udf(_finder(learn(body, sample_texts)), ddl, names)(F.col("text")))
    return rows.select("doc_id", *[F.col(f"__s.{n}").alias(n) for n in names])


def redact(text: str, spans: str) -> str:
    """``text`` with every span replaced by its kind in angle brackets; of overlapping spans the first stands."""
    out, at = [], 0
    for kind, start, end in (s.split(":") for s in spans.split(",") if s):
        if int(start) >= at:
            out += [text[at : int(start)], f"<{kind}>"]
            at = int(end)
    return "".join([*out, text[at:]])
