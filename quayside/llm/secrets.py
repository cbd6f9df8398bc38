"""Secret scanning: patterns propose candidates, a random forest removes false positives.

Patterns for known token shapes, key blocks and assignments are wide on purpose. What
they find is described, as a whole, by its length and alphabet, by how likely its characters
follow each other in ordinary text, by how much of it a dictionary covers, by the path it
stands in and the words next to it. A forest of decision trees, trained from labelled
findings, keeps what is a secret.

The dictionary is the whole words of a public tokenizer's vocabulary, whose path is a
parameter. The model of transitions is learned from it and from the findings' texts without
their secrets.

Labelled findings come as a table; without one, :func:`generated_findings` makes them from
a seed: random keys in the contexts that leak them, and what scanners usually mistake for
keys (identifiers, hashes of files and commits, placeholders, prose, numbers, paths).
"""

from __future__ import annotations

import base64
import json
import random
import re
import string
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_slices

#: Characters before and after a candidate that its features may look at.
NEAR = 60

# Public shapes of tokens.
SHAPES = {
    "aws_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github": r"\bgh[pousr]_[0-9A-Za-z]{36,}\b",
    "slack": r"\bxox[abprs]-[0-9A-Za-z-]{10,}",
    "google": r"\bAIza[0-9A-Za-z_-]{35}",
    "stripe": r"\b[rs]k_(?:live|test)_[0-9A-Za-z]{16,}",
    "jwt": r"\beyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}",
    # Lines of base 64 and the headers of encrypted keys, then the end if it is there: what
    # follows a key that is cut short stays.
    "key_block": r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:(?:\s|\\[rn])*(?:(?:Proc-Type|DEK-Info): ?[0-9A-Za-z,-]+|[0-9A-Za-z+/=]{16,}(?![0-9A-Za-z+/=])))+(?:(?:\s|\\[rn])*(?:[0-9A-Za-z+/=]{1,15}(?:\s|\\[rn])*)?-----END [A-Z ]{0,30}PRIVATE KEY-----)?",
    "url_login": r"(?<=://)[^\s:/@]+:[^\s:/@]{3,}(?=@[\w.-])",
    "assigned": r"""(?i:(?:api|access|auth|secret|private|client|encryption|signing)?[_-]?(?:key|token|secret|passwd|password|pwd|credential)s?)["']?\s*(?:=>|:=|=|:)\s*["']?(?P<value>[^\s"'<>;,]{6,})""",
    "blob": r"(?<![0-9A-Za-z+/_=-])[0-9A-Za-z+/_-]{24,}={0,2}(?![0-9A-Za-z+/_=-])",
}
PATTERN = re.compile("|".join(f"(?P<{name}>{shape})" for name, shape in SHAPES.items()))
#: No shape matches without one of these, or without a long run of key characters.
QUICK = re.compile(r"AKIA|ASIA|gh[pousr]_|xox|AIza|[rs]k_|eyJ|-----BEGIN|://|(?i:key|token|secret|passw|pwd|credential)|[0-9A-Za-z+/_-]{24}")
SECRET_WORDS = frozenset("key token secret password passwd pwd credential credentials auth bearer private login apikey api access signing".split())
HARMLESS_WORDS = frozenset("example sample dummy placeholder changeme your xxxx test todo fake lorem redacted none null true false commit sha sha1 sha256 md5 checksum digest hash etag revision integrity uuid guid id file path version build".split())
COMMON = "the of and to in is that for on with user admin name data file path home index value test list default server client image page table class object import module service manager builder handler request session account message content sample private config version source package".split()
WORDS = re.compile(r"[A-Za-z]+")
HUMP = re.compile(r"([a-z])([A-Z])")
#: The public vocabulary whose whole words are the dictionary.
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
FEATURES = ["length", "digits", "upper", "lower", "symbols", "classes", "changes", "surprise", "rare", "entropy", "repeats", "hex", "vowels", "dictionary", "longest_word", "secret_word", "harmless_word", "assigned", "quoted", "path", "separators", "prose", "shaped", "uuid", "in_candidate_harmless"]


# Kinds of characters: digits, upper case, lower case and what lies beyond ASCII, others.
_KINDS = np.array([0 if chr(c).isdigit() else 1 if chr(c).isupper() else 2 if chr(c).islower() or c == 128 else 3 for c in range(129)])
_HEX, _VOWELS, _JOINTS = (np.array([chr(c) in of for c in range(129)]) for of in ("0123456789abcdefABCDEF", "aeiouAEIOU", "/-_."))


def _codes(value: str) -> np.ndarray:
    """Characters as numbers, all beyond ASCII as one."""
    return np.minimum(np.frombuffer(value.encode("utf-32-le", "surrogatepass"), "<u4"), 128)


def _words(text: str) -> list[str]:
    """Runs of ASCII letters in lower case, parted where lower case turns to upper."""
    return [w.lower() for w in WORDS.findall(HUMP.sub(r"\1 \2", text))]


@cache
def dictionary(path: str = VOCABULARY) -> frozenset[str]:
    """Words of three letters or more that a tokenizer's vocabulary, a file on the driver, has as a whole."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)["model"]["vocab"]
    whole = (t.removesuffix("</w>") for t in found if t.endswith("</w>"))
    return frozenset(w for w in whole if len(w) > 2 and w.isascii() and w.isalpha())


@dataclass
class Text:
    """What ordinary text is like: the words of a dictionary, and how many bits each character
    costs after the one before it."""

    words: frozenset[str]
    bits: np.ndarray

    @classmethod
    def of(cls, words: frozenset[str], texts: list[str]) -> Text:
        counts = np.full((129, 129), 0.1)
        for text in [*sorted(words), *texts]:
            codes = _codes(text)
            np.add.at(counts, (codes[:-1], codes[1:]), 1)
        return cls(words, -np.log2(counts / counts.sum(1, keepdims=True)))


def features(value: str, shape: str, before: str, after: str, text: Text) -> list[float]:
    """Numbers that describe a whole candidate, in the order of FEATURES."""
    n, codes = len(value), _codes(value)
    kinds = _KINDS[codes]
    shares = np.bincount(kinds, minlength=4) / n
    letters = np.bincount(codes)
    letters = letters[letters > 0] / n
    bits = text.bits[codes[:-1], codes[1:]] if n > 1 else np.zeros(1)
    words = _words(value)
    covered = sum(len(w) for w in words if w in text.words)
    near = _words(before[-NEAR:])[-5:] + _words(after[:NEAR])[:2]
    left = before[-3:].rstrip("\"' ")
    return [
        float(n), *shares.tolist(), float((shares > 0).sum()), float((kinds[1:] != kinds[:-1]).sum() / max(1, n - 1)), float(bits.mean()), float((bits > 9).mean()), float(-(letters * np.log2(letters)).sum()),
        float((codes[1:] == codes[:-1]).sum() / max(1, n - 1)), float(_HEX[codes].mean()), float(_VOWELS[codes].mean()), covered / n, float(max(map(len, words), default=0)),
        float(any(w in SECRET_WORDS for w in near)), float(any(w in HARMLESS_WORDS for w in near)), float(left[-1:] in ("=", ":", ">")), float(before[-1:] in ("\"", "'")),
        float("/" in before[-1:] or bool(re.search(r"[\w.-]+/[\w./-]*$", before[-NEAR:]))), float(_JOINTS[codes].mean()), sum(len(w) for w in near) / max(1, len(near)),
        float(shape not in ("assigned", "blob", "url_login")), float(bool(re.fullmatch(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}", value))), float(any(w in HARMLESS_WORDS for w in words)),
    ]


def candidates(text: str | None) -> Iterator[tuple[int, int, str]]:
    """(start, end, shape) of what may be a secret, in order, without overlaps."""
    if not text or not QUICK.search(text):
        return
    for found in PATTERN.finditer(text):
        shape = found.lastgroup if found.lastgroup != "value" else "assigned"
        part = "value" if shape == "assigned" else shape
        yield found.start(part), found.end(part), shape


class Tree:
    """A decision tree as arrays; grown on random features by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, tried: int):
        self.feature, self.cut, self.left, self.right, self.share = [], [], [], [], []
        self._grow(x, y, rng, depth, tried)
        self.feature, self.left, self.right = (np.array(v) for v in (self.feature, self.left, self.right))
        self.cut, self.share = np.array(self.cut), np.array(self.share)

    def _grow(self, x, y, rng, depth, tried) -> int:
        node = len(self.feature)
        for values, value in ((self.feature, -1), (self.cut, 0.0), (self.left, 0), (self.right, 0), (self.share, float(y.mean()))):
            values.append(value)
        if depth == 0 or len(y) < 4 or y.min() == y.max():
            return node
        best = (2 * y.mean() * (1 - y.mean()) * len(y) - 1e-9, -1, 0.0)
        for f in rng.choice(x.shape[1], tried, replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, hits = x[order, f], np.cumsum(y[order])
            at = np.flatnonzero(v[1:] > v[:-1])
            if not len(at):
                continue
            n, p, total = at + 1.0, hits[at], hits[-1]
            rest = len(y) - n
            impurity = 2 * p * (n - p) / n + 2 * (total - p) * (rest - total + p) / rest
            i = int(impurity.argmin())
            if impurity[i] < best[0]:
                best = (impurity[i], int(f), (v[at[i]] + v[at[i] + 1]) / 2)
        _, f, cut = best
        if f < 0:
            return node
        low = x[:, f] <= cut
        self.feature[node], self.cut[node] = f, cut
        self.left[node] = self._grow(x[low], y[low], rng, depth - 1, tried)
        self.right[node] = self._grow(x[~low], y[~low], rng, depth - 1, tried)
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        while True:
            inner = self.feature[at] >= 0
            if not inner.any():
                return self.share[at]
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = np.where(x[rows, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])


@dataclass
class Forest:
    """Trees, and the text that their features are drawn from. Without trees nothing is a secret."""

    trees: list[Tree]
    text: Text

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, text: Text, trees: int = 40, depth: int = 10, seed: int = 7) -> Forest:
        rng = np.random.default_rng(seed)
        tried = max(1, int(np.sqrt(x.shape[1])))
        grown = []
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x))
            grown.append(Tree(x[rows], y[rows], rng, depth, tried))
        return cls(grown, text)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Share of the trees' votes for a secret."""
        return np.mean([t.predict(x) for t in self.trees], axis=0) if len(x) and self.trees else np.zeros(len(x))


def generated_findings(n: int = 3000, seed: int = 11) -> list[tuple[str, str, int]]:
    """(text, candidate, label): findings in context, about as many secrets as others."""
    rng = random.Random(seed)
    alnum, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    take = lambda alphabet, k: "".join(rng.choices(alphabet, k=k))
    # Words of many spellings, so that no single language is learned.
    parts = [a + b for a in "b c d f g l m n p r s t v th sh ch st tr er en".split() for b in "a e i o u an en in on er es al ion ä é ó".split()]
    word = lambda: "".join(rng.choices(parts, k=rng.randint(1, 4)))
    prose = lambda k: " ".join(word() for _ in range(k))
    names = ["token", "secret", "api_key", "apiKey", "password", "access_token", "SECRET_KEY", "auth_token", "client_secret", "private_key", "pwd", "key"]
    plain = ["commit", "sha1", "sha256", "etag", "checksum", "file", "id", "uuid", "revision", "build", "integrity", "md5", "digest"]
    join = lambda: rng.choice([" = ", "=", ": ", " := ", " => ", '="'])

    def secret() -> tuple[str, str]:
        kind = rng.randrange(10)
        if kind == 9:
            value = take(alnum + "!#%*", rng.choice([12, 16, 20, 24, 40, 120]))
            return f"{rng.choice(['https', 'postgres', 'amqp', 'ftp'])}://{word()}:{value}@{word()}.org/{word()}", value
        if kind == 0:
            value = rng.choice(["AKIA", "ASIA"]) + take(string.ascii_uppercase + string.digits, 16)
        elif kind == 1:
            value = rng.choice(["ghp_", "gho_", "ghs_"]) + take(alnum, 36)
        elif kind == 2:
            value = f"xoxb-{take(string.digits, 11)}-{take(alnum, 24)}"
        elif kind == 3:
            value = rng.choice(["sk_live_", "rk_live_"]) + take(alnum, 24)
        elif kind == 4:
            value = "AIza" + take(alnum + "_-", 35)
        elif kind == 5:
            value = ".".join(["eyJ" + take(alnum, rng.randint(15, 40)), take(alnum, rng.randint(20, 90)), take(alnum + "_-", 43)])
        else:
            value = take(rng.choice([alnum, alnum + "+/", alnum + "!#%*", hexa]), rng.choice([16, 20, 24, 32, 40, 40, 44, 48, 64]))
            quote = rng.choice(['"', "'", ""])
            return rng.choice(names) + join() + quote + value + quote, value
        return rng.choice([rng.choice(names) + join() + value, f"{word()} {value}", value]), value

    def harmless() -> tuple[str, str]:
        kind = rng.randrange(12)
        if kind == 11:
            value = rng.choice(["password", "${PASSWORD}", "<password>", "your_password", "changeme", "xxxxxxxx", "example"])
            return f"{rng.choice(['https', 'postgres', 'amqp', 'ftp'])}://{rng.choice(['user', 'name', word()])}:{value}@{word()}.org/{word()}", value
        if kind == 0:
            value = take(hexa, rng.choice([32, 40, 64]))
            return f"{rng.choice(plain)}{join()}{value}", value
        if kind == 1:
            value = str(uuid.UUID(int=rng.getrandbits(128)))
            return f"{rng.choice([*plain, *names])}{join()}{value}", value
        if kind == 2:
            value = rng.choice(["your_api_key_here", "changeme_please", "xxxxxxxxxxxxxxxx", "example_token_value", "<redacted>_value", "os.environ['KEY']", "dummy-password-123", "test_secret_value", "process.env.API_KEY", "placeholder_secret"])
            return rng.choice(names) + join() + value, value
        if kind == 3:
            value = "".join(word().capitalize() for _ in range(rng.randint(5, 9)))
            return f"class {value}", value
        if kind == 4:
            value = "_".join(rng.choices(COMMON, k=rng.randint(4, 7)))
            return f"{rng.choice(['def', 'import', 'var', ''])} {value}", value
        if kind == 5:
            value = "/".join(rng.choices([*COMMON, word()], k=rng.randint(4, 7)))
            return f"{rng.choice(['see', 'path:', 'file'])} {value}", value
        if kind == 6:
            value = "".join(rng.choices(parts, k=rng.randint(9, 16)))  # a long word of prose
            return f"{prose(3)} {value}", value
        if kind == 7:
            value = word() + word()
            return f"{rng.choice(['the token', 'a key', 'its secret', 'password'])}: {value}", value
        if kind == 8:
            value = rng.choice("-_=/") * rng.randint(24, 80)
            return value, value
        if kind == 9:
            value = base64.b64encode(prose(12).encode()).decode().rstrip("=")[: rng.randint(24, 60)]
            return f"data:image/png;base64,{value}", value
        value = take(string.digits, rng.randint(24, 40))
        return f"{word()} {value}", value

    out = []
    while len(out) < n:
        label = rng.randrange(2)
        line, value = secret() if label else harmless()
        text = f"{prose(rng.randint(0, 8))}{rng.choice([' ', chr(10)])}{line}{rng.choice(['', ' ', '###', '.', ' and '])}{rng.choice(['', ' ', chr(10)])}{prose(rng.randint(0, 6))}"
        out.append((text, value, label))
    return out


def train(findings: list[tuple[str, str, int]] | None = None, sample: int = 20_000, vocabulary: str = VOCABULARY, **options) -> Forest:
    """A forest from labelled findings (text, candidate, label), of which the first
    ``sample`` are used. A finding that no pattern proposes teaches nothing; without any
    that does, nothing is a secret."""
    known = (generated_findings() if findings is None else findings)[:sample]
    ordinary = Text.of(dictionary(vocabulary), [text.replace(value, " ") if label else text for text, value, label in known])
    x, y = [], []
    for text, value, label in known:
        for start, end, shape in candidates(text):
            if text[start:end] in value or value in text[start:end]:
                x.append(features(text[start:end], shape, text[max(0, start - NEAR) : start], text[end : end + NEAR], ordinary))
                y.append(label)
    return Forest.fit(np.array(x), np.array(y, float), ordinary, **options) if x else Forest([], ordinary)


def labelled_findings(table: DataFrame, sample: int = 20_000) -> list[tuple[str, str, int]]:
    """Findings from a table (text, candidate, label), for :func:`train`: those of the ``sample``
    smallest hashes, so that the same rows are taken whatever their order. Rows with a null
    do not count."""
    rows = table.select("text", "candidate", F.col("label").cast("int").alias("label")).dropna()
    return [tuple(r) for r in rows.orderBy(F.xxhash64("text", "candidate"), "text", "candidate", "label").limit(sample).collect()]


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("shape", T.StringType()), T.StructField("score", T.DoubleType())]))
ARROW_SPANS = pa.list_(pa.struct({"start": pa.int32(), "end": pa.int32(), "shape": pa.string(), "score": pa.float64()}))


def scan(texts: list[str | None], forest: Forest, threshold: float = 0.5) -> list[list[tuple[int, int, str, float]]]:
    """(start, end, shape, score) of the secrets of each text; offsets count code points."""
    spans, x = [], []
    for i, text in enumerate(texts):
        for start, end, shape in candidates(text):
            spans.append((i, start, end, shape))
            x.append(features(text[start:end], shape, text[max(0, start - NEAR) : start], text[end : end + NEAR], forest.text))
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    for (i, start, end, shape), score in zip(spans, forest.predict(np.array(x)), strict=True):
        if score > threshold:
            out[i].append((start, end, shape, float(score)))
    return out


def redact(text: str | None, spans, mark: str = "[SECRET]") -> str | None:
    """The text with each span replaced; a text without spans as it is."""
    if not text or not len(spans):
        return text
    parts, at = [], 0
    for start, end, *_ in spans:
        parts += [text[at:start], mark]
        at = end
    return "".join([*parts, text[at:]])


def with_secrets(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5) -> DataFrame:
    """Add ``secrets`` (spans) and ``clean_text`` (spans replaced by a mark) to every row.

    Null and empty texts have no spans and stay as they are; repeated rows get equal
    results; other columns are kept, but for any of these two names, which is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest or train())  # trees of a bounded depth, a tokenizer's words

    @F.arrow_udf(T.StructType([T.StructField("spans", SPANS), T.StructField("clean", T.StringType())]))
    def of(texts: pa.Array) -> pa.Array:
        names, found, clean = ("start", "end", "shape", "score"), [], []
        for some in in_slices(texts):
            for text, spans in zip(some, scan(some, shared.value, threshold), strict=True):
                found.append([dict(zip(names, s, strict=True)) for s in spans])
                clean.append(redact(text, spans) if spans else None)  # a text without spans is not sent back
        return pa.StructArray.from_arrays([pa.array(found, ARROW_SPANS), pa.array(clean, pa.string())], names=["spans", "clean"])

    rest = [c for c in docs.columns if c not in ("secrets", "clean_text")]
    said = docs.select(*[F.col(f"`{c}`") for c in rest]).withColumn("_found", of("text"))
    return said.select(*[F.col(f"`{c}`") for c in rest], F.col("_found.spans").alias("secrets"), F.coalesce("_found.clean", "text").alias("clean_text"))


def secret_rows(docs: DataFrame, **options) -> DataFrame:
    """A row for each document: doc_id, n_secrets, spans as text, and the SHA-256 of the redacted text.

    Null and empty texts have no spans and the hash of nothing; repeated rows and null ids have a
    row each; an empty table gives no row."""
    said = with_secrets(docs.select("doc_id", "text"), **options)
    spans = F.concat_ws(",", F.transform("secrets", lambda s: F.concat_ws(":", s["shape"], s["start"].cast("string"), s["end"].cast("string"))))
    return said.select("doc_id", F.size("secrets").cast("long").alias("n_secrets"), spans.alias("spans"), F.sha2(F.coalesce("clean_text", F.lit("")).cast("binary"), 256).alias("clean_sha256"))
