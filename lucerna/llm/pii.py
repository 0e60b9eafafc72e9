"""Personal data by pattern and by a skip-chain conditional random field.

Pattern spans (email, ip, card, phone) are the base and always stay. Tokens are the words of a document that have a
digit or an at sign, and the words that repeat the name part of one of its mail addresses. Over them runs a linear chain
with labels O and the four kinds; tokens that repeat or resemble one another, however far apart, are linked by skip
edges that share one potential. Loopy belief propagation passes messages until they settle, so a part or another
spelling of an entity is found through its full mention, and a number that resembles nothing is not.

The field is trained by pseudo-likelihood on a bounded sample of documents: node weights, the chain potential and the
skip potential are fitted together, each token's label given its neighbours'. Labels are the base spans. As patterns
label no partial mention, the sample's documents get some appended (``with_mentions``): a partial or respelt repetition
of an entity of theirs with its label, a decoy of the same shape with label O, and two entities side by side, which the
patterns fuse into one match and drop for its length. Tokens of other such matches train nothing.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.llm.common import load, stage

KINDS = ("email", "ip", "card", "phone")
LABELS = ("o", *KINDS)
#: The sample that the field is fitted on: documents, in order of a seeded hash, and distinct training rows, the most frequent first.
MAX_FITTED, MAX_ROWS = 6_000, 40_000
MIN_MARGINAL = 0.9
ROUNDS = 30
#: Appended mentions for a document of the sample.
MENTIONS = 2
#: Letters and digits that a repetition of a mail name has at least, and digits that resembling numbers end alike in.
NAME_CHARS, TAIL_DIGITS = 6, 7
#: Neighbouring tokens of these kinds make one span up to so many digits.
MOST_DIGITS = {"card": 19, "phone": 15}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"\S+")
_MARK = re.compile(r"[0-9@]")
_NOT_ALNUM = re.compile(r"[\W_]+")
_SPELT_AT = re.compile(r"[\[({]at[\])}]", re.I)
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Pattern spans by kind as listed, then start; leftmost matches without overlap per kind, failing ones dropped.

    Possessive patterns and the look-behind leave out starts that can't match, so long runs cost linear time.
    """
    out: list[Span] = []
    over, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > over and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            over = m.end()
        at = text.find("@", max(over, at + 1))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) > 4 else p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


def fused_ranges(text: str) -> list[tuple[int, int]]:
    """Card and phone matches with too many digits for one entity."""
    out = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 20 and sum(c.isdigit() for c in m.group()) > 19]
    return sorted(out + [m.span() for m in _PHONE.finditer(text) if m.end() - m.start() >= 17 and sum(c.isdigit() for c in m.group()) > 15])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


class Tokens:
    """Places of the tokens of a text, in order: start and end arrays."""

    def __init__(self, text: str, base: list[Span]):
        names = {name_core(text[a:b].partition("@")[0]) for kind, a, b in base if kind == "email"}
        names = {n for n in names if len(n) >= NAME_CHARS}
        start, end = [], []
        for m in _WORD.finditer(text):
            if _MARK.search(text, m.start(), m.end()) or names and m.end() - m.start() < 256 and name_core(m.group()) in names:
                start.append(m.start())
                end.append(m.end())
        self.text, self.start, self.end = text, np.array(start, dtype=np.int64), np.array(end, dtype=np.int64)
        #: whether a token is chained to the one before it: at most one character lies between them
        self.close = np.r_[False, self.start[1:] - self.end[:-1] <= 1] if len(start) else np.zeros(0, dtype=bool)

    def __len__(self) -> int:
        return len(self.start)

    def word(self, i: int) -> str:
        return self.text[self.start[i] : self.end[i]]

    def labels(self, spans: list[Span]) -> np.ndarray:
        """The label of each token by the spans that it overlaps; of several, the last."""
        out = np.zeros(len(self), dtype=np.int64)
        for kind, a, b in spans:
            out[np.searchsorted(self.end, a, "right") : np.searchsorted(self.start, b, "left")] = LABELS.index(kind)
        return out


def name_core(word: str) -> str:
    """Letters and digits of a word, in lower case."""
    return _NOT_ALNUM.sub("", word.lower())


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """A range without the punctuation at its ends; a leading + or ( and a closing ) stay."""
    while a < b and not (text[a].isalnum() or text[a] in "_+("):
        a += 1
    while a < b and not (text[b - 1].isalnum() or text[b - 1] in "_)"):
        b -= 1
    return a, b


def shape_of(token: str) -> str:
    """Digits as 9, letters as a, runs cut to three; of long tokens the first 64 characters."""
    return re.sub(r"(.)\1{3,}", r"\1\1\1", re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "9", token[:64])))


def own_features(token: str) -> tuple[str, ...]:
    """Features of a trimmed token by itself, its shape first."""
    digits = sum(map(token.count, "0123456789"))
    plain = "".join(c for c in token if c in "0123456789") if 16 <= digits <= 19 else ""
    parts = token.split(".") if len(token) <= 64 else []
    size = next(k for k, most in enumerate((0, 3, 4, 7, 10, 13, 15, 19, 1 << 60)) if digits <= most)
    return (f"shape={shape_of(token)}", f"digits={size}", f"at={token.count('@')}", f"dots={min(token.count('.'), 4)}", f"plus={token[:1] == '+'}", f"paren={'(' in token}", f"dash={min(token.count('-'), 3)}", f"letters={any(c.isalpha() for c in token)}", f"luhn={bool(plain) and luhn(plain)}", f"octets={len(parts) == 4 and all(x.isdigit() and len(x) <= 3 and int(x) <= 255 for x in parts)}")


def coded_features(tokens: Tokens) -> tuple[np.ndarray, list[tuple[str, ...]]]:
    """For each token the number of its own features, and the distinct ones."""
    numbers: dict[tuple[str, ...], int] = {}
    text, code = tokens.text, np.empty(len(tokens), dtype=np.int32)
    for i, (a, b) in enumerate(zip(tokens.start, tokens.end)):
        a, b = trimmed(text, int(a), int(b))
        own = own_features(text[a:b])
        code[i] = numbers.setdefault(own, len(numbers))
    return code, list(numbers)


def skip_keys(token: str) -> list[str]:
    """What resembling tokens share: the last seven digits, or the letters and digits of the token or of its mail name."""
    token = _SPELT_AT.sub("@", token)
    digits = "".join(c for c in token if c in "0123456789")
    keys = ["d" + digits[-TAIL_DIGITS:]] if len(digits) >= TAIL_DIGITS else []
    if any(c.isalpha() for c in token):
        keys += ["t" + core for part in {token, token.partition("@")[0]} if len(core := name_core(part)) >= NAME_CHARS]
    return keys


def skip_edges(tokens: Tokens) -> np.ndarray:
    """Links (i, j), i < j, from each token to the previous and to the first one that it resembles: at most two a key.

    Neighbours in the chain are left out, as the chain links them.
    """
    keys, at = array("Q"), array("q")  # a long text has millions
    for i in range(len(tokens)):
        for key in skip_keys(tokens.word(i)):
            keys.append(xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass")))
            at.append(i)
    key, at = np.array(keys, dtype=np.uint64), np.array(at, dtype=np.int64)
    del keys
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    same = np.flatnonzero(key[1:] == key[:-1]) + 1
    if not len(same):
        return np.zeros((0, 2), dtype=np.int64)
    first = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], np.arange(len(key)), 0))
    pairs = np.concatenate([np.stack([at[same - 1], at[same]], axis=1), np.stack([at[first[same]], at[same]], axis=1)])
    pairs = np.unique(pairs[pairs[:, 0] < pairs[:, 1]], axis=0)
    return pairs[~((pairs[:, 1] == pairs[:, 0] + 1) & tokens.close[pairs[:, 1]])]


class Field:
    """Node weights by feature, chain and skip potentials."""

    def __init__(self, weights: dict[str, np.ndarray], bias: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.weights, self.bias, self.chain, self.skip = weights, bias, chain, skip

    def node_scores(self, tokens: Tokens) -> np.ndarray:
        """Log scores of the labels of each token by its features and the shapes of its neighbours in the chain."""
        code, distinct = coded_features(tokens)
        none = np.zeros(len(LABELS))
        of = lambda features: sum((self.weights.get(f, none) for f in features), none)
        table = lambda rows: np.array(rows, dtype=np.float32).reshape(-1, len(LABELS))
        nodes = table([of(own) for own in distinct])[code] + self.bias.astype(np.float32)
        shape = [own[0].removeprefix("shape=") for own in distinct]
        behind = np.r_[tokens.close[1:], False]
        for side, has, other in (("left", tokens.close, code[np.flatnonzero(tokens.close) - 1]), ("right", behind, code[np.flatnonzero(behind) + 1])):
            nodes[has] += table([of((f"{side}={x}",)) for x in shape])[other]
            nodes[~has] += of((f"{side}=",)).astype(np.float32)
        return nodes

    def marginals(self, nodes: np.ndarray, chain: np.ndarray, skips: np.ndarray) -> np.ndarray:
        """Loopy sum-product over log scores of nodes, chain edges (i, i + 1) by i and skip edges (i, j); damped.

        All edges of a type and direction share one table, so memory is a few rows of floats for each node and edge.
        """
        nodes = nodes.astype(np.float32, copy=False)
        k = nodes.shape[1]
        flows = []  # (from, to, table, messages), each followed by the opposite direction
        behind = chain + 1
        for i, j, table in ((chain, behind, self.chain), (skips[:, 0], skips[:, 1], self.skip)):
            if len(i):
                flows += [(x, y, np.exp(t).astype(np.float32), np.zeros((len(x), k), dtype=np.float32)) for x, y, t in ((i, j, table), (j, i, table.T))]

        def belief() -> np.ndarray:
            out = nodes.copy()
            for _, to, _, mail in flows:
                if to is chain or to is behind:  # no node twice
                    out[to] += mail
                else:
                    for c in range(k):
                        out[:, c] += np.bincount(to, weights=mail[:, c], minlength=len(nodes))
            return out

        def fresh(now: np.ndarray, origin: np.ndarray, table: np.ndarray, back: np.ndarray) -> np.ndarray:
            send = now[origin] - back
            send -= send.max(axis=1, keepdims=True)
            out = np.log(np.exp(send, out=send) @ table)
            out -= out.max(axis=1, keepdims=True)
            return out

        for _ in range(ROUNDS if flows else 0):
            now, moved = belief(), 0.0
            for (x, _, there, mail), (y, _, back, answer) in zip(flows[::2], flows[1::2]):
                for old, new in [*((m, fresh(now, *a)) for m, a in ((mail, (x, there, answer)), (answer, (y, back, mail))))]:
                    new -= old
                    moved = max(moved, float(np.abs(new).max()))
                    new *= 0.5
                    old += new
            if moved < 1e-3:
                break
        p = belief()
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        return p / p.sum(axis=1, keepdims=True)

    def spans(self, text: str, base: list[Span], skip: bool = True) -> list[Span]:
        """Base spans and those that the field adds, by kind as listed, then start; without skip edges if skip is false."""
        tokens = Tokens(text, base)
        if not len(tokens):
            return base
        labels = tokens.labels(base)
        if labels.all():
            return base
        nodes = self.node_scores(tokens)
        known = np.flatnonzero(labels)
        nodes[known] = -12.0  # base spans are evidence
        nodes[known, labels[known]] = 0.0
        nodes[~tokens.close] += self.chain[0].astype(np.float32)  # what stands between tokens is O
        nodes[~np.r_[tokens.close[1:], False]] += self.chain[:, 0].astype(np.float32)
        p = self.marginals(nodes, np.flatnonzero(tokens.close) - 1, skip_edges(tokens) if skip else np.zeros((0, 2), dtype=np.int64))
        label = np.where((labels == 0) & (p.max(axis=1) >= MIN_MARGINAL), p.argmax(axis=1), 0)
        added: list[Span] = []
        at = np.flatnonzero(label)
        for i, k in zip(at.tolist(), label[at].tolist()):
            kind, (a, b) = LABELS[k], trimmed(text, int(tokens.start[i]), int(tokens.end[i]))
            if a == b:
                continue
            if added and kind in MOST_DIGITS and label[i - 1] == k and tokens.close[i]:
                whole = text[added[-1][1] : b]
                if sum(map(whole.count, "0123456789")) <= MOST_DIGITS[kind]:
                    a = added.pop()[1]
            added.append((kind, a, b))
        return sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def partial_mention(kind: str, piece: str, rng: random.Random) -> str | None:
    """A part or another spelling of an entity, which no base pattern takes and skip_keys resembles; None if there is none."""
    digits = "".join(c for c in piece if c in "0123456789")
    if kind == "email":
        name, _, domain = piece.partition("@")
        return name if len(name_core(name)) >= NAME_CHARS and rng.random() < 0.5 else f"{name}{rng.choice(['(at)', '[at]'])}{domain}"
    if kind == "ip":
        return piece.replace(".", rng.choice(["[.]", "_"])) if len(digits) >= TAIL_DIGITS else None
    if kind == "card":
        return rng.choice("._/").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    area, tail = digits[:-7][-3:], f"{digits[-7:-4]}{rng.choice('-.')}{digits[-4:]}"
    return rng.choice([tail, f"({area}) {tail}", f"{area}-{tail}"])


def decoy_of(mention: str, rng: random.Random) -> str:
    """Other digits and letters in the shape of a mention."""
    return "".join(rng.choice("0123456789") if c.isdigit() else rng.choice("abcdefghijklmnopqrstuvwxyz") if c.isalpha() else c for c in mention)


def with_mentions(text: str, base: list[Span]) -> tuple[str, list[Span]]:
    """The text with labelled mentions appended behind it, and the spans of both. Seeded by the text."""
    rng = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    out, spans, length = [text], list(base), len(text)

    def put(piece: str, kind: str | None = None) -> None:
        nonlocal length
        if kind:
            spans.append((kind, length, length + len(piece)))
        out.append(piece)
        length += len(piece)

    for kind, a, b in rng.sample(base, min(MENTIONS, len(base))):
        mention = partial_mention(kind, text[a:b], rng)
        if mention and not base_spans(mention):
            decoy = decoy_of(mention, rng)
            for piece, label in ((mention, kind), (decoy, None)) if rng.random() < 0.5 else ((decoy, None), (mention, kind)):
                put(" and ")
                if label or not base_spans(piece):
                    put(piece, label)
    numbers = [s for s in base if s[0] in ("card", "phone")]
    if numbers:
        kind, a, b = rng.choice(numbers)
        one = text[a:b]
        any_card = "".join(rng.choice("0123456789") for _ in range(15))
        others = [("card", next(any_card + c for c in "0123456789" if luhn(any_card + c)))]
        others.append((None, next(any_card + c for c in "5678901234" if not luhn(any_card + c))))
        others.append((None, any_card[: rng.randrange(2, 5)]))
        others += [("phone", decoy_of(one, rng))] * (kind == "phone") + [(k, text[c:d]) for k, c, d in base if k == "ip"][:1]
        pair = [(kind, one), rng.choice(others)]
        if rng.random() < 0.5 and one[0] != "+":
            pair.reverse()
        # a pattern that finds a card or a phone in the pair takes a wrong piece or leaves nothing to learn
        if all(k == "ip" for k, _, _ in base_spans(" ".join(piece for _, piece in pair))):
            put(" and ")
            for i, (label, piece) in enumerate(pair):
                put(" " * i)
                put(piece, label)
    return "".join(out), spans


def training_rows(text: str) -> Counter:
    """Rows "label, label before, label behind, skip neighbours by label, features" of a document, with their numbers."""
    seen: Counter = Counter()
    longer, spans = with_mentions(text, base_spans(text))
    tokens = Tokens(longer, spans)
    labels = tokens.labels(spans)
    unknown = (Tokens.labels(tokens, [(KINDS[0], a, b) for a, b in fused_ranges(text)]) > 0) & (labels == 0)
    near = np.zeros((len(tokens), len(LABELS)), dtype=np.int64)
    for i, j in skip_edges(tokens).tolist():
        near[i, labels[j]] += not unknown[j]
        near[j, labels[i]] += not unknown[i]
    code, distinct = coded_features(tokens)
    shape = lambda i: "" if i is None else distinct[code[i]][0].removeprefix("shape=")
    for i in range(len(tokens)):
        before = i - 1 if tokens.close[i] else None
        behind = i + 1 if i + 1 < len(tokens) and tokens.close[i + 1] else None
        if unknown[i] or any(x is not None and unknown[x] for x in (before, behind)):
            continue
        sides = [0 if x is None else int(labels[x]) for x in (before, behind)]
        seen["\t".join([*map(str, (int(labels[i]), *sides, *near[i].tolist())), *distinct[code[i]], f"left={shape(before)}", f"right={shape(behind)}"])] += 1
    return seen


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_fitted: int = MAX_FITTED, max_rows: int = MAX_ROWS) -> Field:
    """Trains on at most max_fitted documents that have a digit or an at sign, and max_rows distinct rows of their tokens.

    Without any, nothing is ever added. Null ids and texts train nothing.
    """
    chosen = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter(F.col("text").rlike("[0-9@]"))
    ids = stage(chosen.select("id").filter("id is not null").distinct().orderBy(F.xxhash64("id", F.lit(10)), "id").limit(max_fitted), "op10-ids")

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for t in batch.column(0):
                seen.update(training_rows(t.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["row", "n"])

    counted = chosen.join(F.broadcast(ids), "id").select("text").mapInArrow(observe, "row string, n long").groupBy("row").agg(F.sum("n").alias("n"))  # max_fitted ids
    rows = counted.orderBy(F.col("n").desc(), F.xxhash64("row"), "row").limit(max_rows).collect()
    return fit_field([(tuple(map(int, r.row.split("\t")[:8])), tuple(r.row.split("\t")[8:]), r.n) for r in rows])


def fit_field(training: list[tuple[tuple[int, ...], tuple[str, ...], int]], steps: int = 300, l2: float = 0.1) -> Field:
    """Maximises the L2-penalised pseudo-likelihood of rows ((label, before, behind, near of each label), features, count).

    The chain potential is one table for both neighbours, the skip potential is symmetric. Accelerated gradient descent
    with a diagonal bound on the curvature; the problem is convex.
    """
    k = len(LABELS)
    if not training:
        return Field({}, np.r_[0.0, np.full(k - 1, -20.0)], np.zeros((k, k)), np.zeros((k, k)))
    heavy: Counter = Counter()
    for _, features, n in training:
        for f in features:
            heavy[f] += n
    index = {f: i for i, f in enumerate(sorted(f for f, n in heavy.items() if n >= 3))}
    m = len(index)
    at = np.array([r for r, (_, fs, _) in enumerate(training) for f in fs if f in index], dtype=np.int64)
    cols = np.array([index[f] for _, fs, _ in training for f in fs if f in index], dtype=np.int64)
    known = np.array([t[0] for t in training])
    y, before, behind, near = np.eye(k)[known[:, 0]], np.eye(k)[known[:, 1]], np.eye(k)[known[:, 2]], known[:, 3:].astype(float)
    n = np.array([float(t[2]) for t in training])[:, None]
    size = (np.bincount(at, minlength=len(training)) + 3.0 + near.sum(axis=1))[:, None] * n
    sums = lambda x: np.stack([np.bincount(cols, weights=x[at, c], minlength=m) for c in range(k)], axis=1)
    curve = [np.repeat(0.5 * np.bincount(cols, weights=size[at, 0], minlength=m)[:, None] + l2, k, axis=1), np.full(k, 0.5 * size.sum() + l2)]
    ahead, back, skip = ((0.5 * (size * x).sum(axis=0))[:, None] for x in (before, behind, near))
    curve += [ahead + back.T + l2, skip + skip.T + l2]
    w = [np.zeros((m, k)), np.zeros(k), np.zeros((k, k)), np.zeros((k, k))]
    v, t = [x.copy() for x in w], 1.0
    for _ in range(steps):
        z = np.stack([np.bincount(at, weights=v[0][cols, c], minlength=len(training)) for c in range(k)], axis=1) + v[1] + before @ v[2] + behind @ v[2].T + near @ v[3]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        miss = (p / p.sum(axis=1, keepdims=True) - y) * n
        pull = near.T @ miss
        g = [sums(miss), miss.sum(axis=0), before.T @ miss + (behind.T @ miss).T, (pull + pull.T) / 2]
        fresh = [a - (b + l2 * a) / c for a, b, c in zip(v, g, curve)]
        u = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v = [a + (t - 1) / u * (a - b) for a, b in zip(fresh, w)]
        w, t = fresh, u
    return Field({f: w[0][i] for f, i in index.items()}, w[1], w[2], w[3])


def find_pii(docs: DataFrame, found: Field, id_col: str = "doc_id", text_col: str = "text", skip: bool = True) -> DataFrame:
    """One row per document row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans (base and added).

    Null counts as empty, which has no spans. Offsets count code points, ends are exclusive. Rows that repeat an id
    each get theirs, other columns are ignored, an empty table gives no rows. One narrow pass; a text takes memory in
    proportion to its tokens. skip: whether repetitions are linked.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    sent = spark.sparkContext.broadcast(found)  # at most ten features for each of MAX_ROWS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            counts, shas, spans = [], [], []
            for t in batch.column(1):
                text = t.as_py() or ""
                raw = text.encode("utf-8", "surrogatepass")
                if len(raw.translate(None, b"0123456789@")) == len(raw):
                    base, every = [], []
                else:
                    base = base_spans(text)
                    every = model.spans(text, base, skip)
                counts.append([sum(s[0] == kind for s in base) for kind in KINDS])
                shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(shas, pa.string()), pa.array(spans, pa.string())], names=["id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return find_pii(docs, fit(docs))


QUERIES = {"op10_pii": op10_pii}
ORACLE_SQL: dict[str, str] = {}
