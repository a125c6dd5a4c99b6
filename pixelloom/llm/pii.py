"""Personal data by a skip-chain conditional random field.

Patterns find the base spans. A document with some becomes a random field over
its tokens: those of base spans (observed), those that repeat or resemble them
or a part of them, and numbers beside those. Neighbouring tokens are linked as a
chain, and occurrences of the same or a similar token, however far apart, are
linked by skip edges, weaker ones for short groups of digits. Loopy belief
propagation then lets a plain repetition of a number or a name, in one token or
in several, take the label of the full form elsewhere in the document; tokens
of one label beside each other are one span.

The weights are trained here, with the base spans of a bounded sample as labels:
unary weights on the shape of a token by regularised softmax regression, chain
and skip weights from how often linked tokens agree.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelloom.llm.common import pieces, saved, texts_of

SAMPLE_ROWS = 1500
KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
ROUNDS = 8
WHOLE_DIGITS = 7  # so many digits in common are a repetition, fewer are a weaker link
SHAPE_FLOOR = -2.0  # most that a shape speaks against a label, as short forms are not among the training labels

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# the runs of digits are possessive: a shorter run would fail in the same place
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\s/=:;,|<>\[\]{}\"'\u2018\u2019\u201c\u201d]+")
_GROUP = re.compile(r"[0-9]+")
_EDGES = ".,;:!?()[]{}<>\"'"

SPANS = T.ArrayType(
    T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]
    )
)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind index) of the four patterns, by start, then kind."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        first = at
        while first > last and text[first - 1] in _LOCAL:
            first -= 1
        domain = _DOMAIN.match(text, at + 1) if first < at else None
        if domain:
            last = domain.end()
            out.append((first, last, 0))
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out)


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def _name(s: str) -> str:
    return s.strip(_EDGES + "@._-").lower().replace("_", ".").replace("-", ".")


def _keys(kind: int, s: str) -> list[str]:
    """What makes a token, or the joined digits of a run of tokens, a repetition of an entity of this kind."""
    core, digits = s.strip(_EDGES).lower(), _digits(s)
    keys = [core] if len(core) >= 5 else []
    if kind == 0 and "@" in core:
        local = core.split("@")[0]
        names = {_name(local), _name(local.split("+")[0])}
        keys.extend("@" + x for x in sorted(names) if len(x) >= 4 and ("." in x or any(c.isdigit() for c in x)))
    if kind == 2:
        keys.append("#" + digits)
    if kind == 3:  # with and without the codes in front
        keys.extend("#" + digits[-n:] for n in range(7, len(digits) + 1))
    return keys


FEATURES = 16


def shape(token: str, before: str) -> np.ndarray:
    """What a token looks like, without asking whether a pattern matched."""
    core, digits = token.strip(_EDGES), _digits(token)
    n = max(1, len(core))
    return np.array([
        1.0, "@" in core, len(digits) / n, len(digits) >= 7, len(digits) >= 12, core.count(".") == 3, core.count(".") > 0,
        "-" in core, token.startswith("+"), "(" in token, core.isalpha(), any(c.isalpha() for c in core) and bool(digits),
        n >= 6, n >= 15, before.startswith("+") or before.startswith("("), not digits,
    ], float)


@dataclass(frozen=True)
class PiiModel:
    unary: np.ndarray  # FEATURES x labels
    chain: np.ndarray  # labels x labels, log potentials of neighbours
    skip: float  # log potential of equal labels on a skip edge


def _tokens(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, token); a token ends where a base span, or a run of overlapping ones, begins or ends."""
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end, _ = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][1])
            i += 1
        for a, b in ((at, start), (start, end)):
            out.extend((m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text, a, b))
        at = end
    out.extend((m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text, at))
    return out


def _observed(tokens, spans) -> list[int]:
    """The label of the base span that covers each token, else 0."""
    out, i = [0] * len(tokens), 0
    for start, end, kind in spans:
        while i and tokens[i - 1][1] > start:
            i -= 1
        while i < len(tokens) and tokens[i][1] <= start:
            i += 1
        j = i
        while j < len(tokens) and tokens[j][0] < end:
            out[j] = out[j] or kind + 1
            j += 1
    return out


def fit(texts: list[str], ridge: float = 2e-3, rounds: int = 300) -> PiiModel:
    """Weights from the base spans of the texts; with none, a model that adds nothing of its own.

    The skip weight is the log odds of agreement among repeated tokens, held
    between 3 and 6 as a sample may have few repetitions.
    """
    rows, labels = [], []
    chain = np.ones((len(LABELS), len(LABELS)))
    same, apart = 1.0, 1.0
    for text in texts:
        spans = base_spans(text)
        tokens = _tokens(text, spans)
        seen = _observed(tokens, spans)
        last: dict[str, int] = {}
        for i, (_, _, token) in enumerate(tokens):
            core = token.strip(_EDGES).lower()
            rich = any(c in "0123456789@+" for c in token)
            if rich or i % 50 == 0:
                rows.append(shape(token, tokens[i - 1][2] if i else ""))
                labels.append(seen[i])
            if i:
                chain[seen[i - 1], seen[i]] += 1
            if rich and len(core) >= 5:
                if core in last:
                    same, apart = (same + 1, apart) if last[core] == seen[i] else (same, apart + 1)
                last[core] = seen[i]
    unary = np.zeros((FEATURES, len(LABELS)))
    if rows:
        x, y = np.array(rows), np.eye(len(LABELS))[labels]
        weight = 1 / np.maximum(y.sum(axis=0), 1)[labels]
        weight = weight / weight.sum()
        step = 1.0
        for _ in range(rounds):
            raw = x @ unary
            p = np.exp(raw - raw.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            unary -= step * (x.T @ ((p - y) * weight[:, None]) + ridge * unary)
    chain /= chain.sum(axis=1, keepdims=True)
    even = chain / np.maximum(chain.sum(axis=0, keepdims=True) / len(LABELS), 1e-9)
    return PiiModel(unary, np.clip(np.log(even), -2, 2), float(np.clip(np.log(same / apart), 3.0, 6.0)))


def _beliefs(unary: np.ndarray, edges: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """Marginals by loopy sum-product with damping; edges hold log potentials (first, second)."""
    k = unary.shape[1]
    a = np.array([e[0] for e in edges] + [e[1] for e in edges])
    b = np.array([e[1] for e in edges] + [e[0] for e in edges])
    pot = np.exp(np.stack([e[2] for e in edges] + [e[2].T for e in edges]))
    m = len(edges)
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    message = np.zeros((2 * m, k))
    for _ in range(ROUNDS):
        total = unary.copy()
        np.add.at(total, b, message)
        out = total[a] - message[back]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        new = np.log(np.einsum("ek,ekl->el", out, pot))
        message = 0.5 * message + 0.5 * (new - new.max(axis=1, keepdims=True))
    total = unary.copy()
    np.add.at(total, b, message)
    p = np.exp(total - total.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _beside(text: str, left: tuple[int, int, str], right: tuple[int, int, str]) -> bool:
    """Nothing but a few blanks or slashes between two tokens."""
    return right[0] - left[1] <= 3 and not text[left[1] : right[0]].strip(" \t\r\n\u00a0/")


def _plain(token: str) -> bool:
    return not any(map(str.isalpha, token))


class _Entities:
    """Keys of the base spans of a document; each key with the covered token it links to."""

    def __init__(self, text: str, base, tokens, seen):
        self.whole: dict[tuple[str, int], int] = {}
        self.parts: dict[tuple[str, int], int] = {}
        self.pairs: set[tuple[str, str]] = set()
        first = 0
        for start, end, kind in base:
            while first and tokens[first - 1][1] > start:
                first -= 1
            while tokens[first][1] <= start:
                first += 1
            for key in _keys(kind, text[start:end]):
                self.whole.setdefault((key, kind), first)
            if kind >= 2:
                groups = _GROUP.findall(text[start:end])
                self.pairs.update(zip(groups[:-1], groups[1:]))
                for g in groups:
                    self.parts.setdefault((g, kind), first)
        self.longest = max((len(k) for k, _ in self.whole if k[0] == "#"), default=0)

    def repeated(self, *keys: str) -> list[tuple[tuple[str, int], int]]:
        return [(own, self.whole[own]) for key in dict.fromkeys(keys) for kind in range(len(KINDS)) if (own := (key, kind)) in self.whole]

    def number(self, digits: str) -> list[tuple[tuple[str, int], int]]:
        """Repetitions of a number, also with zeros in front."""
        return self.repeated("#" + digits, "#" + digits.lstrip("0")) if len(digits) >= WHOLE_DIGITS else []

    def links(self, token: str) -> list[tuple[tuple[str, int], int, float]]:
        """(key, covered token, strength from 0 to 1) of the links of one token."""
        name = _name(token)
        found = [(k, at, min(1.0, (len(name) / 5) ** 2) if k[0][0] == "@" else 1.0) for k, at in self.repeated(token.strip(_EDGES).lower(), "@" + name)]
        digits = _digits(token)
        found += [(k, at, 1.0) for k, at in self.number(digits)]
        if not found and digits and _plain(token):
            groups = _GROUP.findall(token)
            if all(p in self.pairs for p in zip(groups[:-1], groups[1:])):
                strength = min(1.0, (len(digits) / WHOLE_DIGITS) ** 2)
                found = [((digits, kind), self.parts[groups[0], kind], strength) for kind in (2, 3) if (groups[0], kind) in self.parts]
        return found


def _runs(text: str, tokens, seen, entities: _Entities):
    """(first, last, links): tokens next to each other of which the digits together repeat a base span."""
    i = 0
    while i < len(tokens):
        best, digits, j = None, "", i
        while j < len(tokens) and not seen[j] and _plain(tokens[j][2]) and (j == i or _beside(text, tokens[j - 1], tokens[j])):
            own = _digits(tokens[j][2])
            digits += own
            if not digits or len(digits) > entities.longest + 3 or j - i > 2 * entities.longest:
                break
            if j > i and own and (links := entities.number(digits)):
                best = i, j, links
            j += 1
        if best:
            yield best
            i = best[1]
        i += 1


def all_spans(text: str, model: PiiModel) -> list[tuple[int, int, int, bool]]:
    """(start, end, kind index, base): the base spans, and those that the random field adds.

    Nodes are the tokens of base spans (known), tokens that repeat one of them or a
    part of it, alone or as a run, and numbers and signs beside such a token.
    """
    base = base_spans(text)
    if not base:
        return []
    tokens = _tokens(text, base)
    seen = _observed(tokens, base)
    entities = _Entities(text, base, tokens, seen)
    links = {i: own for i, (_, _, token) in enumerate(tokens) if not seen[i] and (own := entities.links(token))}
    sure = {i for i, own in links.items() if any(strength == 1 for _, _, strength in own)}
    run_of: dict[int, int] = {}
    for first, last, own in _runs(text, tokens, seen, entities):
        for i in range(first, last + 1):
            run_of[i] = first
            sure.add(i)
            links[i] = [(k, at, 1.0) for k, at in own]
    if not links:
        return [(*s, True) for s in base]
    near = {
        j for i in links for j in (i - 1, i + 1)
        if 0 <= j < len(tokens) and j not in links and not seen[j] and _plain(tokens[j][2]) and _beside(text, tokens[min(i, j)], tokens[max(i, j)])
    }
    # the labels of covered tokens are known, so their messages are part of the potentials of the others
    nodes = sorted(near.union(links))
    place = {i: n for n, i in enumerate(nodes)}
    unary = np.stack([shape(tokens[i][2], tokens[i - 1][2] if i else "") for i in nodes]) @ model.unary
    unary -= unary[:, :1].copy()
    for n, i in enumerate(nodes):
        token = tokens[i][2]
        if i in near:  # what any repetition has, a link, is missing
            unary[n, 1:] = -model.skip
        elif _plain(token) and len(_digits(token)) < WHOLE_DIGITS:  # a short number may be anything
            unary[n, 1:] = SHAPE_FLOOR
        else:
            unary[n] = np.maximum(unary[n], SHAPE_FLOOR)
        for _, at, strength in links.get(i, ()):
            unary[n, seen[at]] += model.skip * strength
        if i and seen[i - 1] and _beside(text, tokens[i - 1], tokens[i]):
            unary[n] += model.chain[seen[i - 1]]
        if i + 1 < len(tokens) and seen[i + 1] and _beside(text, tokens[i], tokens[i + 1]):
            unary[n] += model.chain[:, seen[i + 1]]
    edges, last = [], {}
    agree = np.eye(len(LABELS)) * model.skip
    joined = set()
    for n, i in enumerate(nodes):
        if i - 1 in place and _beside(text, tokens[i - 1], tokens[i]):
            chain = model.chain
            groups = _GROUP.findall(tokens[i - 1][2])[-1:] + _GROUP.findall(tokens[i][2])[:1]
            same_run = i in run_of and run_of[i] == run_of.get(i - 1)
            if same_run:
                chain = chain + agree
            elif tuple(groups) in entities.pairs:
                chain = chain + agree * min(1.0, (sum(map(len, groups)) / WHOLE_DIGITS) ** 2)
            if same_run or i not in sure or i - 1 not in sure:
                joined.add(i)
            edges.append((n - 1, n, chain))
        for key, _, strength in links.get(i, ()):
            if key in last and run_of.get(last[key], -1) != run_of.get(i, -2):
                edges.append((place[last[key]], n, agree * strength))
            last[key] = i
    belief = _beliefs(unary, edges) if edges else unary
    added: list[list[int]] = []
    before = 0
    for n, i in enumerate(nodes):
        label = int(belief[n].argmax())
        if label and label == before and i in joined:
            added[-1][1] = tokens[i][1]
        elif label:
            added.append([tokens[i][0], tokens[i][1], label - 1])
        before = label
    out = [(*s, True) for s in base]
    for start, end, kind in added:
        start, end = _trimmed(text, start, end)
        if start < end:
            out.append((start, end, kind, False))
    return sorted(out)


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """Without signs at the ends, other than a plus before and the brackets of what is inside."""
    first, last = start, end
    while start < end and not text[start].isalnum():
        start += 1
    while start < end and not text[end - 1].isalnum():
        end -= 1
    inside = text[start:end]
    if inside.count("(") > inside.count(")") and ")" in text[end:last]:
        end = text.index(")", end) + 1
    elif inside.count(")") > inside.count("(") and "(" in text[first:start]:
        start = text.rindex("(", first, start)
    elif text[start:end] and "(" in text[first:start] and ")" in text[end:last]:
        start, end = text.rindex("(", first, start), text.index(")", end) + 1
    if start > first and text[start - 1] == "+":
        start -= 1
    return start, end


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> PiiModel:
    """Fits on at most `rows` documents, chosen by a seeded hash among those with a base span of any kind."""
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("mark", F.xxhash64("text"))

    def with_spans(batches):
        for batch in batches:
            column = texts_of(batch.column(1))
            some = []
            for _, buf, at in pieces(pa.RecordBatch.from_arrays([column], names=["text"])):
                rich = np.concatenate([[0], np.cumsum((buf == 64) | ((buf >= 48) & (buf <= 57)))])[at]
                some += [bool(n) and bool(base_spans(buf[at[i] : at[i + 1]].tobytes().decode())) for i, n in enumerate(np.diff(rich).tolist())]
            yield batch.filter(pa.array(some, pa.bool_())).select([0, 2])

    # one text for each id, however many rows repeat it
    chosen = texts.mapInArrow(with_spans, "doc_id long, mark long").groupBy("doc_id").agg(F.min("mark").alias("mark"))
    chosen = saved(chosen.orderBy(F.xxhash64(F.lit("pii"), "doc_id"), "doc_id").limit(rows), "pii-sample")
    got = texts.join(F.broadcast(chosen), ["doc_id", "mark"]).groupBy("doc_id").agg(F.min("text").alias("text"))
    got = got.orderBy("doc_id").select("text").toArrow()
    return fit([t for t in got.column(0).to_pylist() if t])


def _spans_of(batch: pa.RecordBatch, model: PiiModel):
    """For each row the spans, or None where the text has neither digit nor @."""
    texts = texts_of(batch.column(batch.schema.get_field_index("text")))
    found = []
    for _, buf, at in pieces(pa.RecordBatch.from_arrays([texts], names=["text"])):
        some = np.concatenate([[0], np.cumsum((buf == 64) | ((buf >= 48) & (buf <= 57)))])[at]
        for i, rich in enumerate((np.diff(some) > 0).tolist()):
            found.append(all_spans(buf[at[i] : at[i + 1]].tobytes().decode(), model) if rich else None)
    return found


def find(docs: DataFrame, model: PiiModel | None = None) -> DataFrame:
    """doc_id, spans array<kind, start, end, base>: one row per row of docs(doc_id, text).

    Positions are code points, ends exclusive, order by start, then kind. Null
    and empty texts have no spans. Repeated rows stay repeated; other columns
    are ignored. Without a model one is trained on the documents themselves.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = model or train(docs)

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for batch in batches:
            spans = [
                [{"kind": KINDS[k], "start": a, "end": b, "base": base} for a, b, k, base in own or ()] for own in _spans_of(batch, model)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("spans", SPANS)])
    return docs.mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """The text with every span, or run of overlapping spans, as its kind in brackets."""
    out, at = [], 0
    for start, end, kind, _ in spans:
        if start >= at:
            out.append(text[at:start])
            out.append(f"[{KINDS[kind].upper()}]")
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: PiiModel | None = None) -> DataFrame:
    """docs with the personal data of text masked; all other columns as they are, null texts null."""
    model = model or train(docs)
    types = {f.name: f.dataType for f in docs.schema}
    if types["text"] != T.StringType():
        raise ValueError("text must be a string")

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            column = batch.column(at)
            found = _spans_of(batch, model)
            if any(found):
                texts = [
                    masked(t, own) if own else t for t, own in zip(column.to_pylist(), found)
                ]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, column.type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
