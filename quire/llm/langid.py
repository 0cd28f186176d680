"""Language identification by a linear-chain conditional random field.

Words of a text, code-switched or not, are labelled with languages. A word's
features are its affixes, its character 2- and 3-grams, and itself if it is in
the lexicon of the training sample, all hashed into one weight table;
transitions between labels are learned with it. Forward-backward gives each
word's posterior; a text's language is the one with the largest expected number
of words, and its score the share of that number.

Training takes a bounded sample of labelled rows (`per_label` documents a
label, `spans` word spans of each). Words carry the label of their document;
half of the sequences join spans of several documents, which is what
transitions are learned from. A chain is at most CHAIN words long; a longer
text is several chains.

All letters of a text count. A run of more than LONGEST letters, such as a
sentence of a script without spaces, is several words: pieces of about equal
size, each with a place of its own in the chain and in the share.

Whether a text is in a learned language at all is not told by shares, which sum
to one in any case, but by its evidence: the share of its words' 3-grams and
affixes of three and four characters that occur in two training documents at least. `Model.least` lies halfway between the
evidence of random letters and what all but one in a hundred training documents
have from the others; neither depends on the number of labels.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"[^\W\d_]+")
BUCKETS, CHAIN, LONGEST = 1 << 16, 64, 64
U = np.uint64
PRIME, SPREAD = U(0x100000001B3), U(0x9E3779B97F4A7C15)
#: Words whose label scores a worker holds at once; the memory is then emptied.
MOST_WORDS = 150_000
ROWS = 200
UNKNOWN = "und"


def pieces(run: str) -> Iterator[str]:
    """A run of letters in pieces of at most LONGEST letters and the two after them, so
    that each n-gram lies in one; a hyphen stands where the run goes on."""
    step = -(-len(run) // -(-len(run) // LONGEST))
    for at in range(0, len(run), step):
        end = at + step + 2
        yield f"{'-' if at else ''}{run[at:end]}{'-' if at + step < len(run) else ''}"


def words_of(text: str) -> list[str]:
    found = WORD.findall(text.lower())
    if max(map(len, found), default=0) <= LONGEST:
        return found
    return [p for w in found for p in (pieces(w) if len(w) > LONGEST else (w,))]


def features(words: list[str], lexicon: frozenset[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """(feature numbers, number of the word that each belongs to) of many words at once,
    and how many of those come before the ones of three characters and more."""
    held = [f"<{w}>".replace("<-", "").replace("->", "") for w in words]
    sizes = np.fromiter(map(len, held), np.int64, len(held))
    code = np.frombuffer("".join(held).encode("utf-32-le"), "<u4").astype(U)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = ends[owner] - np.arange(len(code))
    known = [(zlib.crc32(w.encode()) % BUCKETS, i) for i, w in enumerate(words) if w in lexicon]
    flat, of = [np.array([x[0] for x in known], np.int64)], [np.array([x[1] for x in known], np.int64)]
    h = code
    for n in (2, 3, 4):  # h holds a hash of the n characters from each place on
        h = h[:-1] * PRIME + code[n - 1 :]
        long = sizes >= n
        grams = np.flatnonzero(left[: len(h)] >= n) if n < 4 else np.zeros(0, np.int64)
        for role, at in enumerate(((ends - sizes)[long], ends[long] - n, grams)):
            mixed = (h[at] ^ U(3 * n + role)) * SPREAD
            flat.append(((mixed ^ mixed >> U(29)) * SPREAD >> U(48)).astype(np.int64))
            of.append(owner[at])
    return np.concatenate(flat), np.concatenate(of), sum(map(len, flat[:4]))


def by_word(flat: np.ndarray, of: np.ndarray, n: int) -> list[np.ndarray]:
    return np.split(flat[np.argsort(of, kind="stable")], np.cumsum(np.bincount(of, minlength=n))[:-1])


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # BUCKETS x labels
    transitions: np.ndarray
    lexicon: frozenset[str]
    known: np.ndarray  # of each bucket, whether two training documents have it
    least: float = 0.0  # evidence of a text in a learned language


def posteriors(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of padded chains (chain, position, label): word posteriors, forward and
    backward messages. Positions past a chain's length are zero."""
    e = np.exp(scores - scores.max(2, keepdims=True))
    m = np.exp(transitions - transitions.max())
    n, width, k = e.shape
    inside = np.arange(width)[None, :] < lengths[:, None]
    fore, back = np.empty_like(e), np.empty_like(e)
    fore[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for t in range(1, width):
        a = (fore[:, t - 1] @ m) * e[:, t]
        fore[:, t] = a / a.sum(1, keepdims=True)
    back[:, -1] = 1.0
    for t in range(width - 2, -1, -1):
        b = (back[:, t + 1] * e[:, t + 1]) @ m.T
        b /= b.sum(1, keepdims=True)
        back[:, t] = np.where(inside[:, t + 1, None], b, 1.0)
    p = fore * back
    p /= p.sum(2, keepdims=True)
    return np.where(inside[:, :, None], p, 0.0), fore, back


def sequences(texts: list[tuple[str, int]], spans: int, seed: int = 7) -> list[tuple[list[str], list[int]]]:
    """Word sequences with labels: spans of single texts, and as many of joined ones."""
    random = np.random.default_rng(seed)
    cut = []
    for text, label in texts:
        words = [w for w in words_of(text) if w.isalpha() or any(map(str.isalpha, w))]
        for _ in range(spans if words else 0):
            at = int(random.integers(0, max(1, len(words) - CHAIN // 2)))
            cut.append((words[at : at + CHAIN], label))
    plain = [(w, [label] * len(w)) for w, label in cut]
    joined = []
    for _ in range(len(cut)):
        words, labels = [], []
        while len(words) < CHAIN:
            w, label = cut[int(random.integers(len(cut)))]
            n = min(len(w), int(random.integers(4, 24)), CHAIN - len(words))
            words += w[:n]
            labels += [label] * n
        joined.append((words, labels))
    return plain + joined


def calibrate(model: Model, documents: list[list[np.ndarray]], words: list[str]) -> None:
    """Sets what is known, and the least evidence, from the features of each training document's words."""
    met = np.zeros(BUCKETS, np.int64)
    held = [np.concatenate(d) for d in documents]
    for d in held:
        met[np.unique(d)] += 1
    model.known = met >= 2
    clean = np.quantile([(met[d] >= 3).mean() for d in held], 0.01)  # known without the document itself
    random = np.random.default_rng(5)
    letters = np.array(sorted(set("".join(words)) - {"-"}))
    made = ["".join(random.choice(letters, len(w))) for w in random.choice(np.array(words, object), 4096)]
    flat, _, skip = features(made, model.lexicon)
    model.least = float(clean + model.known[flat[skip:]].mean()) / 2


def fit_texts(texts: list[tuple[str, str]], spans: int = 2, epochs: int = 4, rate: float = 0.2, decay: float = 1e-5) -> Model:
    """A model from (text, label) rows by gradient steps on the conditional likelihood."""
    labels = sorted({label for _, label in texts})
    k = len(labels)
    made = sequences([(t, labels.index(label)) for t, label in texts], spans)
    counts = Counter(w for words, _ in made for w in words)
    model = Model(labels, np.zeros((BUCKETS, k)), np.eye(k), frozenset(w for w, c in counts.items() if c >= 3), np.zeros(BUCKETS, bool))
    if not counts:
        return model
    words = list(counts)
    flat, of, skip = features(words, model.lexicon)
    table = dict(zip(words, by_word(flat, of, len(words)), strict=True))
    grams = dict(zip(words, by_word(flat[skip:], of[skip:], len(words)), strict=True))
    calibrate(model, [[grams[w] for words, _ in made[at : at + spans] for w in words] for at in range(0, len(made) // 2, spans)], words)
    if k < 2:
        return model
    square, square_t = np.full((BUCKETS, k), 1e-6), np.full((k, k), 1e-6)
    random = np.random.default_rng(11)
    for _ in range(epochs):
        order = random.permutation(len(made))
        for at in range(0, len(order), 64):
            batch = [made[i] for i in order[at : at + 64]]
            lengths = np.array([len(w) for w, _ in batch])
            rows = [table[w] for words, _ in batch for w in words]
            flat, sizes = np.concatenate(rows), np.array([len(r) for r in rows])
            word_scores = np.add.reduceat(model.weights[flat], np.cumsum(sizes) - sizes)
            inside = np.arange(CHAIN)[None, :] < lengths[:, None]
            scores, gold = np.zeros((len(batch), CHAIN, k)), np.zeros((len(batch), CHAIN, k))
            scores[inside] = word_scores
            gold[inside] = np.eye(k)[np.concatenate([y for _, y in batch])]
            p, fore, back = posteriors(scores, lengths, model.transitions)
            error = (p - gold)[inside]
            slope = np.zeros((BUCKETS, k))
            np.add.at(slope, flat, np.repeat(error, sizes, axis=0))
            seen = np.unique(flat)
            g = slope[seen] / len(batch) + decay * model.weights[seen]
            square[seen] += g * g
            model.weights[seen] -= rate * g / np.sqrt(square[seen])
            e = np.exp(scores - scores.max(2, keepdims=True))
            both = inside[:, 1:]
            pair = (fore[:, :-1, :, None] * np.exp(model.transitions - model.transitions.max())[None, None] * (e * back)[:, 1:, None, :])[both]
            pair /= pair.sum((1, 2), keepdims=True)
            g = (pair.sum(0) - np.einsum("ntk,ntl->kl", gold[:, :-1] * both[:, :, None], gold[:, 1:])) / len(batch) + decay * model.transitions
            square_t += g * g
            model.transitions = model.transitions - rate * g / np.sqrt(square_t)
    return model


def trainable(doc_id: Column) -> Column:
    """Whether labels of a row may be learned from: crc32 of its id, as text, mod 4 is not 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(True))


def fit(docs: DataFrame, per_label: int = 300, spans: int = 2) -> Model:
    """Learns from text and non-null lang of trainable rows: about per_label
    rows of each label, chosen by a hash of doc_id. The driver gets the counts
    of labels and that sample."""
    rows = docs.select("doc_id", "text", "lang").filter(trainable(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    chance = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    if not counts:
        return fit_texts([])
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_label / n))]), F.col("lang"))
    sample = [(r["text"], r["lang"]) for r in rows.filter(chance < share).select("text", "lang").collect()]
    return fit_texts(sorted(sample), spans)


class Labeler:
    """Words are numbered as they come; their label scores are kept."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.scores, self.lettered = np.zeros((0, len(self.model.labels))), np.zeros(0, bool)
        self.sizes = np.zeros((0, 2))  # of a word, longer features that are known, and all

    def lookup(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Numbers of words in self.scores; words without a letter are left out."""
        if len(self.ids) > MOST_WORDS:
            self.clear()
        found = [np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words)) for words in texts]
        fresh = list(islice(reversed(self.ids), len(self.ids) - len(self.scores)))[::-1]
        if fresh:
            flat, of, skip = features(fresh, self.model.lexicon)
            weights = self.model.weights[flat]
            new = [np.bincount(of, weights[:, j], len(fresh)) for j in range(weights.shape[1])]
            self.scores = np.concatenate((self.scores, np.stack(new, 1) if new else np.zeros((len(fresh), 0))))
            self.sizes = np.concatenate((self.sizes, np.stack((np.bincount(of[skip:], self.model.known[flat[skip:]], len(fresh)), np.bincount(of[skip:], minlength=len(fresh))), 1)))
            self.lettered = np.concatenate((self.lettered, np.fromiter((any(map(str.isalpha, w)) for w in fresh), bool, len(fresh))))
        return [x[self.lettered[x]] for x in found]

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        return self.weigh(texts)[:2]

    def weigh(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Label, score and evidence of each text."""
        numbers = self.lookup([words_of(t) if t else [] for t in texts])
        k = len(self.model.labels)
        n_words = np.array([len(x) for x in numbers])
        if not k or not n_words.sum():
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        chains = -(-n_words // CHAIN)
        owner = np.repeat(np.arange(len(texts)), chains)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(chains) - chains, chains)
        lengths = np.minimum(CHAIN, n_words[owner] - nth * CHAIN)
        scores = np.zeros((len(owner), CHAIN, k))
        scores[np.arange(CHAIN)[None, :] < lengths[:, None]] = self.scores[np.concatenate(numbers)]
        p, _, _ = posteriors(scores, lengths, self.model.transitions)
        share = np.zeros((len(texts), k))
        np.add.at(share, owner, p.sum(1))
        share /= np.maximum(n_words, 1)[:, None]
        top = share.argmax(1)
        found = n_words > 0
        sizes = np.array([self.sizes[x].sum(0) for x in numbers])
        evidence = (sizes[:, 0] / np.maximum(sizes[:, 1], 1)).tolist()
        return [self.model.labels[i] if ok else UNKNOWN for i, ok in zip(top, found, strict=True)], [min(1.0, float(share[r, i])) if ok else 0.0 for r, (i, ok) in enumerate(zip(top, found, strict=True))], evidence


def predict(docs: DataFrame, model: Model, keep: list[str], evidence: bool = False) -> DataFrame:
    """The `keep` columns with lang_pred and score, and evidence if asked for, of every row, from the text alone.

    A text that is null or has no letter is `und` with score 0, as is every
    text if nothing was learned. Equal texts get equal results; an empty table
    gives no rows. Very long texts are many chains, and take memory of their size.
    """
    added = ["lang_pred", "score", *["evidence"] * evidence]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: BUCKETS rows and the lexicon of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeler = Labeler(sent.value)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                labels, *numbers = labeler.weigh(b.column(place).to_pylist())
                made = [pa.array(labels, pa.string()), *[pa.array(x, pa.float64()) for x in numbers[: len(added) - 1]]]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *made], [*keep, *added])

    given = docs.select(*keep, *[] if "text" in keep else ["text"])
    place = given.columns.index("text")
    schema = T.StructType([*given.schema.fields[: len(keep)], *[T.StructField(c, T.StringType() if c == "lang_pred" else T.DoubleType()) for c in added]])
    return given.mapInArrow(run, schema)
