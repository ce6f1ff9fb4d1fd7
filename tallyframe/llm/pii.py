"""Personal data in whole texts: fixed patterns, and a skip-chain conditional random field that carries them further.

Patterns find e-mail addresses, IP addresses, card and phone numbers. The field's nodes are the words with a digit or
an at sign (any other word is outside); neighbours in the text share a chain potential, and occurrences of the same
word, or of the same four or more digits, share a skip potential, however far apart they are. Words inside a pattern's span are observed;
each occurrence is linked to the next and to the nearest observed one, so what the patterns found reaches all of a text at once.
Loopy message passing, until messages stop changing, gives every other word its label's probability, so a number that is
written in full once is found again where its form is too short for the pattern. Runs of one label outside the patterns'
spans are divided into pieces that are probable enough and look like their kind (at line ends first), and these are added to the spans.

The weights are fitted by pseudo-likelihood on at most SAMPLE distinct texts that have such words (those of the least hash;
their bytes are what the driver holds), with the patterns' spans as labels. A card number that fails its checksum is none, however often it stands there. Scanning and message passing read whole texts of all documents.

Defined results: a null or empty text has no spans; a null doc_id is kept; rows that repeat are scanned each; an empty
table gives no rows; without a text to fit on nothing is added to the patterns; other columns are ignored (``redact`` keeps them).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .base import WORD, map_rows

KINDS = ("email", "ip", "card", "phone")
#: Texts that fitting reads at most.
SAMPLE = 1500
#: Messages of a text have stopped changing when none moves by more.
STILL = 1e-4
#: Rounds without progress, or nodes of a text if more, after which its messages move by half as much: so each text comes to an end.
PATIENCE = 100
SURE = 0.9
#: Words of a piece at most: no kind has more digits.
WORDS = 19
#: Where fitting starts for equal labels at the ends of a skip edge; few texts have repeated words to learn it from.
CONSISTENT = 3.0
STEPS = 150
RATE = 0.2

Span = tuple[int, int, int]  # kind, start, end

_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")
_EDGE = "\"'.,;:!?*#$%&<>[]{}|()"

#: Names of the node features.
FEATURES = (
    "always", "at", "at_dot", "plus", "open", "dash", "comma", "letters", "dots1", "dots2", "dots3", "dots4", "digits0", "digits1", "digits2", "digits3",
    "digits4", "digits5_6", "digits7_9", "digits10_12", "digits13_15", "digits16_19", "digits20", "first", "last", "equals", "slash", "checked", "unchecked",
)
_AT = {name: i for i, name in enumerate(FEATURES)}
N = len(KINDS) + 1  # labels; 0 is outside


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = int(d) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address pattern, found from their at signs so that long words cost no more than short."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (host := _HOST.match(text, at)):
            end = host.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[Span]:
    """By kind, then start."""
    out: list[Span] = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not any(d in text for d in "0123456789"):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def node_features(word: str) -> list[int]:
    own = ["always"]
    digits = sum("0" <= c <= "9" for c in word)
    if "@" in word:
        own.append("at")
        if "." in word.partition("@")[2].strip(_EDGE):
            own.append("at_dot")
    if dots := word.strip(_EDGE).count("."):
        own.append(f"dots{min(dots, 4)}")
    own.append(
        f"digits{digits}" if digits <= 4 else "digits5_6" if digits <= 6 else "digits7_9" if digits <= 9 else "digits10_12" if digits <= 12
        else "digits13_15" if digits <= 15 else "digits16_19" if digits <= 19 else "digits20"
    )
    own += [n for n, c in (("plus", "+"), ("open", "("), ("dash", "-"), ("comma", ","), ("equals", "="), ("slash", "/")) if c in word]
    if any(c.isalpha() for c in word):
        own.append("letters")
    if 16 <= digits <= 19:
        own.append("checked" if luhn("".join(c for c in word if "0" <= c <= "9")) else "unchecked")
    return [_AT[x] for x in own]


class Graph:
    """The nodes of some texts, with their chain and skip edges and what the patterns say of them."""

    def __init__(self) -> None:
        self.text: list[int] = []
        self.span: list[tuple[int, int]] = []
        self.seen: list[int] = []
        self.feature_node: list[int] = []
        self.feature: list[int] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []

    def add(self, number: int, text: str, base: list[Span]) -> None:
        first, end = len(self.text), 0
        words: list[tuple[int, int]] = []
        for m in _SIGN.finditer(text):
            if m.start() < end:
                continue
            start = max([end, *(text.rfind(c, end, m.start()) + 1 for c in " \t\n\x0b\x0c\r")])
            end = WORD.match(text, start).end()
            words.append((start, end))
        base_at = sorted((a, b, kind) for kind, a, b in base)
        by_key: dict[str, list[int]] = {}
        k, reach, label_of = 0, 0, 0
        for i, (a, b) in enumerate(words):
            node, word = first + i, text[a:b]
            while k < len(base_at) and base_at[k][0] < b:
                if base_at[k][1] >= reach:
                    reach, label_of = base_at[k][1], base_at[k][2] + 1
                k += 1
            self.text.append(number)
            self.span.append((a, b))
            self.seen.append(label_of if reach > a else 0)
            own = node_features(word)
            near = i > 0 and a - words[i - 1][1] == 1
            own += [] if near else [_AT["first"]]
            own += [] if i + 1 < len(words) and words[i + 1][0] - b == 1 else [_AT["last"]]
            self.feature += own
            self.feature_node += [node] * len(own)
            if near:
                self.chain.append((node - 1, node))
            digits = "".join(c for c in word if "0" <= c <= "9")
            for key in {word.strip(_EDGE).lower(), "#" + digits if len(digits) >= 4 else ""} - {""}:
                by_key.setdefault(key, []).append(node)
        for same in by_key.values():
            self.skip += zip(same, same[1:], strict=False)
            observed = [i for i, node in enumerate(same) if self.seen[node]]
            for i, node in enumerate(same) if observed else ():
                at = bisect_left(observed, i)
                near = min(observed[max(0, at - 1) : at + 1], key=lambda o: abs(o - i))
                if abs(near - i) > 1:  # nearer ones are linked already, an observed one is its own nearest
                    self.skip.append((same[near], node))

    def node_scores(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.text), N))
        np.add.at(out, np.array(self.feature_node, int), weights[np.array(self.feature, int)])
        return out


def fit(texts: list[str]) -> dict[str, np.ndarray] | None:
    """Weights of features, chain and skip edges that make each node likely given its neighbours."""
    graph = Graph()
    for i, text in enumerate(texts):
        graph.add(i, text, base_spans(text))
    if not graph.text:
        return None
    y = np.array(graph.seen)
    hot = np.eye(N)[y]
    x = np.zeros((len(y), len(FEATURES)))
    x[graph.feature_node, graph.feature] = 1
    chain, skip = np.array(graph.chain, int).reshape(-1, 2), np.array(graph.skip, int).reshape(-1, 2)
    left, right, far = np.zeros_like(hot), np.zeros_like(hot), np.zeros_like(hot)
    left[chain[:, 1]], right[chain[:, 0]] = hot[chain[:, 0]], hot[chain[:, 1]]
    np.add.at(far, skip[:, 0], hot[skip[:, 1]])
    np.add.at(far, skip[:, 1], hot[skip[:, 0]])
    # a word outside all spans that is linked to one inside may be what the patterns miss: its label isn't known
    known = np.ones((len(y), 1))
    for i, j in ((skip[:, 0], skip[:, 1]), (skip[:, 1], skip[:, 0])):
        known[i[(y[i] == 0) & (y[j] > 0)]] = 0
    w = {"node": np.zeros((len(FEATURES), N)), "chain": np.zeros((N, N)), "skip": CONSISTENT * np.eye(N)}
    prior = {k: a.copy() for k, a in w.items()}
    m, v = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}
    for t in range(1, STEPS + 1):
        score = x @ w["node"] + left @ w["chain"] + right @ w["chain"].T + far @ w["skip"]
        p = np.exp(score - score.max(axis=1, keepdims=True))
        e = known * (hot - p / p.sum(axis=1, keepdims=True)) / len(y)
        g = {"node": x.T @ e, "chain": left.T @ e + (right.T @ e).T, "skip": far.T @ e}
        g["skip"] = (g["skip"] + g["skip"].T) / 2
        for k in w:
            step = g[k] - 1e-5 * (w[k] - prior[k])
            m[k], v[k] = 0.9 * m[k] + 0.1 * step, 0.99 * v[k] + 0.01 * step**2
            w[k] += RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return w


def marginals(graph: Graph, w: dict[str, np.ndarray]) -> np.ndarray:
    """Label probabilities by loopy sum-product message passing; observed nodes keep their label.

    Texts share no edge: each is left alone once its messages are still.
    """
    own = np.exp(np.clip(graph.node_scores(w["node"]), -30, 30))
    seen = np.array(graph.seen)
    own[seen > 0] = np.eye(N)[seen[seen > 0]]
    own /= own.sum(axis=1, keepdims=True)
    ends = np.array(graph.chain + graph.skip, int).reshape(-1, 2)
    if not len(ends):
        return own
    both = np.exp(np.clip(np.stack([w["chain"], w["skip"]]), -30, 30))
    both = np.concatenate([both, both.transpose(0, 2, 1)])  # chain, skip, and the same the other way
    _, text = np.unique(graph.text, return_inverse=True)
    nodes = np.bincount(text)
    prior = np.log(own + 1e-30)
    total = prior.copy()
    source, target = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]])
    kind = np.repeat([0, 1, 2, 3], [len(graph.chain), len(graph.skip)] * 2)
    messages = np.full((len(source), N), 1.0 / N)
    step, least, stalled = np.full(len(nodes), 0.5), np.full(len(nodes), np.inf), np.zeros(len(nodes), int)
    while len(source):
        half = len(source) // 2
        log = prior.copy()
        np.add.at(log, target, np.log(messages + 1e-30))
        out = log[source] - np.log(messages[np.concatenate([np.arange(half) + half, np.arange(half)])] + 1e-30)  # without the message the other way
        out = np.exp(out - out.max(axis=1, keepdims=True))
        fresh = np.einsum("en,enm->em", out, both[kind])
        change = step[text[source]][:, None] * (fresh / fresh.sum(axis=1, keepdims=True) - messages)
        messages = messages + change
        moved = np.zeros(len(nodes))
        np.maximum.at(moved, text[source], np.abs(change).max(axis=1))
        better = moved < 0.9 * least
        least, stalled = np.where(better, moved, least), np.where(better, 0, stalled + 1)
        tired = stalled > np.maximum(PATIENCE, nodes)
        step[tired] /= 2
        stalled[tired] = 0
        still = (moved <= STILL)[text[source]]
        if still.any():
            np.add.at(total, target[still], np.log(messages[still] + 1e-30))
            source, target, kind, messages = source[~still], target[~still], kind[~still], messages[~still]
    belief = np.exp(total - total.max(axis=1, keepdims=True))
    return belief / belief.sum(axis=1, keepdims=True)


def looks_like(kind: int, found: str) -> bool:
    digits = sum("0" <= c <= "9" for c in found)
    if kind == 0:
        name, _, host = found.partition("@")
        return bool(name and host)
    if kind == 1:
        parts = found.split(".")
        return len(parts) == 4 and all(p.isdigit() and p.isascii() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if any(c.isalpha() for c in found) or "@" in found:
        return False
    if kind == 2:
        return 16 <= digits <= 19 and luhn("".join(c for c in found if "0" <= c <= "9"))
    return 7 <= digits <= 15 and not re.fullmatch(r"[0-9]+(?:[.,][0-9]+)*", found)


def divided(text: str, kind: int, words: list[tuple[int, int]], sure: list[bool]) -> list[tuple[int, int]]:
    """Pieces of a run of words, all sure and each like its kind: those that hold most words, with the fewest line ends inside.

    Of these the fewest pieces, but the most for addresses, which have no blanks.
    """
    sign = 1 if KINDS[kind] == "email" else -1
    best: list[tuple[int, int, int]] = [(0, 0, 0)]
    piece: list[tuple[int, int, int] | None] = [None]  # first word, start and end of the piece that ends here
    for j in range(1, len(words) + 1):
        best.append(best[-1])
        piece.append(None)
        lines = 0
        for i in range(j - 1, max(-1, j - 1 - WORDS), -1):
            if not sure[i]:
                break
            a, b = words[i][0], words[j - 1][1]
            found = text[a:b]
            kept = found.rstrip(_EDGE).lstrip(_EDGE.replace("(", ""))
            a = b - len(found.lstrip(_EDGE.replace("(", "")))
            own = (best[i][0] + j - i, best[i][1] - lines, best[i][2] + sign)
            if own > best[j] and looks_like(kind, kept):
                best[j], piece[j] = own, (i, a, a + len(kept))
            lines += text[words[i][0] - 1] != " "
    out, j = [], len(words)
    while j:
        if own := piece[j]:
            out.append(own[1:])
        j = own[0] if own else j - 1
    return out


def all_spans(texts: list[str], weights: dict[str, np.ndarray] | None) -> list[tuple[list[Span], list[Span]]]:
    """For each text the patterns' spans, and those with what the field adds, by kind and start."""
    bases = [base_spans(t) for t in texts]
    spans = [list(b) for b in bases]
    graph = Graph()
    if weights is not None:
        for i, t in enumerate(texts):
            if _SIGN.search(t):
                graph.add(i, t, bases[i])
    if graph.text:
        p = marginals(graph, weights)
        label, sure = p.argmax(axis=1), p.max(axis=1)
        linked = {b for _, b in graph.chain}
        k = 0
        while k < len(graph.text):
            upto = k + 1
            while upto in linked and label[upto] == label[k] and bool(graph.seen[upto]) == bool(graph.seen[k]):
                upto += 1
            if label[k] and not graph.seen[k]:
                i, kind = graph.text[k], int(label[k]) - 1
                spans[i] += [(kind, a, b) for a, b in divided(texts[i], kind, graph.span[k:upto], (sure[k:upto] >= SURE).tolist())]
            k = upto
    return [(b, sorted(s)) for b, s in zip(bases, spans, strict=True)]


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def fitted(docs: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray] | None:
    """Weights from at most ``sample`` distinct texts, those of the least hash; this many reach the driver, at any size."""
    number, has_sign = F.xxhash64("text"), F.col("text").rlike(r"[0-9][0-9]|@")
    # hashes alone say which texts; every task then sends those only, each once
    least = docs.where(has_sign).select(number.alias("h")).distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if least is None:
        return None
    chosen = docs.where((number <= least) & has_sign).select("text").distinct()
    return fit(sorted(r["text"] for r in chosen.collect()))


RESULT = StructType([StructField("doc_id", LongType()), *(StructField(f"n_{k}", LongType()) for k in KINDS), StructField("base_sha256", StringType()), StructField("spans", StringType())])


def scan(docs: DataFrame) -> DataFrame:
    """Counts and hash of the patterns' spans, and all spans, of every row of ``docs`` (doc_id, text)."""
    weights = fitted(docs)

    def run(doc_ids: pa.Array, texts: pa.Array) -> dict[str, list]:
        found = all_spans([t or "" for t in texts.to_pylist()], weights)
        out: dict[str, list] = {"doc_id": doc_ids} | {f"n_{k}": [sum(s[0] == i for s in base) for base, _ in found] for i, k in enumerate(KINDS)}
        return out | {"base_sha256": [hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found], "spans": [listed(every) for _, every in found]}

    return map_rows(docs, ["doc_id", "text"], run, RESULT)


def masked(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind, all its columns and rows kept."""
    weights, names = fitted(docs), docs.columns

    def run(*columns: pa.Array) -> dict[str, list]:
        out = dict(zip(names, columns, strict=True))
        texts = out["text"].to_pylist()
        found = all_spans([t or "" for t in texts], weights)
        out["text"] = [t and masked(t, every) for t, (_, every) in zip(texts, found, strict=True)]
        return out

    return map_rows(docs, names, run, docs.schema)
