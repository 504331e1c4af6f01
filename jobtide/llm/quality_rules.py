"""Quality rules: line sequence labelling by a linear-chain conditional random field.

Every line gets on/off features (length, symbols, capitals, repetition, punctuation). A
two-label chain (content, boilerplate) scores each line and each step between lines; Viterbi
decoding labels all lines of a text at once. A document stays if its base counts are sound and at
least ``MIN_CONTENT`` of its words lie in content lines.

The field is trained here by gradient ascent on the conditional likelihood, from at most
``per_class`` labelled documents of each class with the least hash of the id (a bounded sample; each
line takes the label of its document). Everything else reads every row and the whole text.

Rows: null and empty texts have no words, fail the base rule and are not kept. Without labels of
both classes every line counts as content, and the base rule alone decides. Repeated rows and null
ids are kept or dropped each by its own text. Extra columns pass through or are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from jobtide.llm.common import WORD, per_value, struct_of
from jobtide.llm.quality_classifier import sample_ids

PER_CLASS = 1000
MIN_WORDS, MAX_REPEATED, MIN_CONTENT = 50, 50, 0.5
CHUNK, STEPS, RATE, RIDGE = 32, 60, 0.5, 1e-3
CONTENT, BOILERPLATE = 0, 1
SYMBOLS = np.zeros(128, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
PUNCTUATION = np.zeros(128, bool)
PUNCTUATION[[ord(c) for c in "!?;:()[]{}/\\=_~^@\"'`+"]] = True
SPACE = np.zeros(128, bool)
SPACE[[0x20, *range(9, 14)]] = True
# Upper bounds of the bins of each measure; a measure above the last bound has a bin of its own.
BINS = {
    "words": (0, 1, 3, 6, 12, 40, 150),
    "symbols": (0, 0.01, 0.05, 0.15, 0.4),      # of the characters of words
    "punctuation": (0, 0.02, 0.05, 0.15),
    "capitals": (0, 0.03, 0.1, 0.3, 0.6),
    "digits": (0, 0.02, 0.1, 0.3),
    "word length": (2, 3.5, 5, 7, 9, 12),
    "repeated": (0, 0.1, 0.25, 0.5, 0.75),      # words equal to the one before
    "distinct": (0.1, 0.3, 0.5, 0.7, 0.9),
}
FLAGS = ("seen before", "ends as a sentence", "starts with a capital", "ends with a symbol")
WIDTH = sum(len(b) + 1 for b in BINS.values()) + len(FLAGS)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RESULT = ("struct<" + ", ".join(f"{name}: bigint" for name in BASE)
          + ", base_failed: boolean, content_words: bigint, labels: array<tinyint>, kept: boolean>")
KIND = struct_of(**{name: pa.int64() for name in BASE}, base_failed=pa.bool_(), content_words=pa.int64(),
                 labels=pa.list_(pa.int8()), kept=pa.bool_())


def repeated_words(words: list[str]) -> int:
    """Words that lie in a three-word window found at least twice."""
    if len(words) < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1].astype(np.int64)
    _, where, counts = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    often = counts[where] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift:len(often) + shift] |= often
    return int(covered.sum())


def lines_of(text: str) -> tuple[dict, np.ndarray, np.ndarray]:
    """Base counts of a text, and the feature numbers and word counts of its lines that have words."""
    words = WORD.findall(text)
    seen: set[str] = set()
    rows, sizes, duplicates = [], [], 0
    lines = [(line, found) for line in text.split("\n") if (found := WORD.findall(line))]
    total_symbols = sum(map(text.count, "#*$%&|<>"))
    for line, found in lines:
        codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
        plain = codes[codes < 128]
        chars = len(codes) - int(SPACE[plain].sum())
        count = len(found)
        capitals = int(((plain >= 65) & (plain <= 90)).sum()) if line.isascii() else sum(map(str.isupper, line))
        measures = (
            count, int(SYMBOLS[plain].sum()) / chars, int(PUNCTUATION[plain].sum()) / chars, capitals / chars,
            int(((plain >= 48) & (plain <= 57)).sum()) / chars, chars / count,
            sum(a == b for a, b in zip(found, found[1:])) / count, len(set(found)) / count)
        row, at = [], 0
        for value, bounds in zip(measures, BINS.values()):
            row.append(at + sum(value > b for b in bounds))
            at += len(bounds) + 1
        flags = (line in seen, found[-1][-1] in ".!?…", found[0][:1].isupper(),
                 found[-1][-1] in "#*$%&|<>!")
        rows.append([*row, *[at + i if flag else -1 for i, flag in enumerate(flags)]])
        sizes.append(count)
        duplicates += line in seen
        seen.add(line)
    base = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": total_symbols,
            "n_dup_lines": duplicates, "n_repeat_words": repeated_words(words)}
    return base, np.array(rows, np.int16).reshape(len(rows), len(BINS) + len(FLAGS)), np.array(sizes, np.int64)


def line_scores(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(lines, 2) scores; feature number -1 stands for a flag that is off."""
    return np.vstack([weights, np.zeros(2)])[features].sum(axis=1)


def viterbi(scores: np.ndarray, steps: np.ndarray) -> list[int]:
    """The best labels of a sequence; of equal ones content first."""
    (to_a, to_b), back = (scores[0].tolist() if len(scores) else (0.0, 0.0)), []
    (aa, ab), (ba, bb) = steps.tolist()
    for a, b in scores[1:].tolist():
        from_a, from_b = to_a + aa >= to_b + ba, to_a + ab >= to_b + bb
        back.append((0 if from_a else 1, 0 if from_b else 1))
        to_a, to_b = (to_a + aa if from_a else to_b + ba) + a, (to_a + ab if from_b else to_b + bb) + b
    if not len(scores):
        return []
    labels = [CONTENT if to_a >= to_b else BOILERPLATE]
    for step in reversed(back):
        labels.append(step[labels[-1]])
    return labels[::-1]


def train(sequences: list[tuple[np.ndarray, int]]) -> dict:
    """Weights of a field from (line features, label of all lines) pairs, by gradient ascent (Adagrad).

    Long sequences are cut into stretches of CHUNK lines, all of which count.
    """
    parts = [(f[i:i + CHUNK], label) for f, label in sequences for i in range(0, len(f), CHUNK)]
    model = {"weights": np.zeros((WIDTH, 2)), "steps": np.zeros((2, 2))}
    if len({label for _, label in parts}) < 2:
        return model
    longest = max(len(f) for f, _ in parts)
    features = np.full((len(parts), longest, len(BINS) + len(FLAGS)), -1, np.int16)
    real = np.zeros((len(parts), longest), bool)
    for n, (f, _) in enumerate(parts):
        features[n, :len(f)], real[n, :len(f)] = f, True
    gold = np.array([label for _, label in parts])
    class_weight = np.where(gold == 1, 0.5 / max(real[gold == 1].sum(), 1), 0.5 / max(real[gold == 0].sum(), 1))
    grads = [np.full((WIDTH, 2), 1e-8), np.full((2, 2), 1e-8)]
    flat = features[real]
    slots = np.where(flat < 0, WIDTH, flat).ravel()
    for _ in range(STEPS):
        scores = np.zeros((*real.shape, 2))
        scores[real] = line_scores(flat, model["weights"])
        lines, steps = expectations(scores, real, model["steps"])
        wanted = np.zeros_like(lines)
        wanted[np.arange(len(gold)), :, gold] = 1.0
        miss = ((wanted - lines) * real[..., None] * class_weight[:, None, None])[real]
        up = np.stack([np.bincount(slots, np.repeat(miss[:, k], flat.shape[1]), WIDTH + 1) for k in (0, 1)], axis=1)
        pairs = real[:, 1:].sum(axis=1)
        up_steps = -(steps * class_weight[:, None, None]).sum(axis=0)
        for label in (0, 1):
            up_steps[label, label] += (pairs * class_weight)[gold == label].sum()
        for name, grad, seen in (("weights", up[:-1], grads[0]), ("steps", up_steps, grads[1])):
            grad = grad - RIDGE * model[name]
            seen += grad * grad
            model[name] = model[name] + RATE * grad / np.sqrt(seen)
    return model


def expectations(scores: np.ndarray, real: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label shares of each line and summed step counts of each sequence (forward-backward)."""
    count, length, _ = scores.shape
    ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
    ahead[:, 0] = scores[:, 0]
    for t in range(1, length):
        new = np.logaddexp.reduce(ahead[:, t - 1, :, None] + steps, axis=1) + scores[:, t]
        ahead[:, t] = np.where(real[:, t, None], new, ahead[:, t - 1])
    for t in range(length - 2, -1, -1):
        new = np.logaddexp.reduce(steps + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
        behind[:, t] = np.where(real[:, t + 1, None], new, 0.0)
    total = np.logaddexp.reduce(ahead[:, -1], axis=1)
    lines = np.exp(ahead + behind - total[:, None, None])
    pairs = np.zeros((count, 2, 2))
    for t in range(1, length):
        p = np.exp(ahead[:, t - 1, :, None] + steps + (scores[:, t] + behind[:, t])[:, None, :] - total[:, None, None])
        pairs += p * real[:, t, None, None]
    return lines, pairs


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
        text_col: str = "text", per_class: int = PER_CLASS) -> dict:
    """A field from the documents of a bounded sample of labels (1: content, 0: boilerplate)."""
    ids = sample_ids(labels, label_col, id_col, F.lit(True), per_class)
    packed = per_value(docs.sparkSession, lambda: _packed, "binary", pa.binary())
    texts = docs.select(F.col(id_col).alias("sample_id"), F.col(text_col).alias("sample_text"))
    found = (texts.join(ids, "sample_id").select("sample_id", "label", packed("sample_text").alias("lines"))
             .orderBy(F.xxhash64("sample_id"), "sample_id", "label", "lines").limit(4 * per_class).collect())
    return train([(np.frombuffer(r.lines, np.int16).reshape(-1, len(BINS) + len(FLAGS)), 1 - r.label)
                  for r in found if r.lines])


def _packed(text: str | None) -> bytes:
    return lines_of(text or "")[1].tobytes()


def verdict(model: dict, text: str | None) -> dict:
    base, features, sizes = lines_of(text or "")
    failed = base["n_words"] < MIN_WORDS or 100 * base["n_repeat_words"] > MAX_REPEATED * base["n_words"]
    labels = viterbi(line_scores(features, model["weights"]), model["steps"])
    content = int(sizes[np.array(labels, int) == CONTENT].sum()) if labels else 0
    kept = not failed and content >= MIN_CONTENT * base["n_words"]
    return base | {"base_failed": failed, "content_words": content, "labels": labels, "kept": kept}


def judge(docs: DataFrame, model: dict, text_col: str = "text", into: str = "rules") -> DataFrame:
    """``docs`` with one more column ``into``: base counts, labels of the lines with words, verdict."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    one = per_value(docs.sparkSession, lambda: lambda text: verdict(shared.value, text), RESULT, KIND)
    return docs.withColumn(into, one(F.col(text_col)))
