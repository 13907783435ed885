"""Personal data in whole texts: fixed patterns, and a character-level BiLSTM-CRF that adds spans.

The network is trained on spans that the patterns find in a bounded sample of the documents, each also in
other spellings (no plus sign, dots for dashes, "(at)", "[dot]"). Texts are cut into overlapping windows on
a fixed grid; the tag scores of all windows over a character are averaged, weighted towards window centres,
and each stretch of overlapping windows is decoded as one sequence, so a span may cross any number of
windows. A span is added if it has the form of its kind and does not meet a span of the patterns.

Every form holds a digit, an at sign or a spelled-out one ("(at)", "[at]", "at" between blanks) before a
host and a dot, so windows far from all of these are scored only where a decoded span leads to them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.llm import bilstm_crf
from clickloom.llm.sparse_ftrl import free_name
from clickloom.llm.tables import text_batches
from clickloom.llm.words import byte_set, pieces, release, tidy

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of every kind

# fixed values: the patterns of the base spans, written so that each is matched in linear time
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# fixed values: the forms that an added span must have
_ADDED = {
    "email": re.compile(
        r"[A-Za-z0-9._%+-]+\s*(?:@|\(at\)|\[at\]|\sat\s)\s*[A-Za-z0-9-]+(?:\s*(?:\.|\(dot\)|\[dot\]|\sdot\s)\s*[A-Za-z0-9-]+)+"
    ),
    "ip": re.compile(r"[0-9]{1,3}(?:\s*(?:\.|\(dot\)|\[dot\]|\[\.\]|\(\.\))\s*[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9]{4}(?:[\x20./-]{0,3}[0-9]{2,6}){2,4}"),
    "phone": re.compile(r"[+(]{0,2}[0-9]{1,4}(?:[\x20()./-]{1,3}[0-9]{2,5}){2,5}"),
}
# what every form holds one of: a digit or an at sign, or an at sign as a word before a host and a dot
_TRIGGER = byte_set((0x30, 0x39), (0x40, 0x40))
_AT_WORD = re.compile(
    r"(?:\(at\)|\[at\]|(?<=\s)at(?=\s))(?=\s*[A-Za-z0-9-]++\s*(?:\.|\(dot\)|\[dot\]|\sdot\s))"
)
# bytes that may stand around the word: brackets, blanks, and parts of blanks beyond ASCII
_BEFORE_AT = byte_set((0x09, 0x0D), (0x1C, 0x20), (0x28, 0x28), (0x5B, 0x5B), (0x80, 0xFF))
_AFTER_AT = byte_set((0x09, 0x0D), (0x1C, 0x20), (0x29, 0x29), (0x5D, 0x5D), (0x80, 0xFF))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches found from their at signs: the local part is the run of its characters before one."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
            at = text.find("@", end)
        else:
            # the local part of the next one cannot reach behind this sign
            end = max(end, at + 1)
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the fixed patterns, in order of start and kind."""
    out = [(a, b, 0) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def well_formed(text: str, kind: str) -> bool:
    """Whether a decoded span may be added."""
    if not _ADDED[kind].fullmatch(text):
        return False
    digits = _digits(text)
    if kind == "ip":
        return all(int(x) <= 255 for x in re.findall(r"[0-9]+", text))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    return True


def triggers(data: np.ndarray) -> np.ndarray:
    """Positions in UTF-8 bytes of all that a span is looked for around, and of some more."""
    found = _TRIGGER[data]
    if len(data) >= 4:
        word = (data[1:-2] == ord("a")) & (data[2:-1] == ord("t"))
        found[1:-2] |= word & _BEFORE_AT[data[:-3]] & _AFTER_AT[data[3:]]
    return np.flatnonzero(found)


def _symbols(text: str) -> np.ndarray:
    """One of 98 symbols for every character: ASCII as it is, other letters as one, other signs as one."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = np.where((codes >= 32) & (codes < 127), codes - 31, 0)
    out = np.where(codes >= 128, 96, out)
    return np.where(codes == 10, 97, out).astype(np.int16)


SYMBOLS = 98


def _letters_alone(span: str, rng: np.random.Generator) -> str:
    """A labelled address without digits, its at sign spelled out."""
    letters = "abcdefghijklmnopqrstuvwxyz"

    def word(m: re.Match) -> str:
        return "".join(letters[k] for k in rng.integers(26, size=int(rng.integers(2, 8))))

    if rng.integers(2):
        span = re.sub(r"[._%+-]+(?=[0-9]+@)", "", span)
        span = re.sub(r"(?<=[A-Za-z])[0-9]+", "", span)
    span = re.sub(r"[0-9]+", word, span)
    at, dot = [(" (at) ", "."), ("(at)", "."), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" at ", " dot ")][int(rng.integers(5))]
    return span.replace("@", at).replace(".", dot)


def _other_spellings(span: str, kind: int, rng: np.random.Generator) -> str:
    """A labelled span in another spelling of its kind."""
    pick = int(rng.integers(4))
    if kind == 0:
        at, dot = [("@", "."), (" (at) ", "."), ("[at]", "[dot]"), (" at ", " dot ")][pick]
        return span.replace("@", at).replace(".", dot) if pick else span
    if kind == 1:
        return span.replace(".", [".", "[.]", "[dot]", "(dot)"][pick])
    digits = _digits(span)
    if kind == 2:
        mark = [" ", "-", ".", "/"][pick]
        return mark.join(digits[k : k + 4] for k in range(0, len(digits), 4))
    if pick == 0:
        return span
    a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
    return [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"][pick - 1]


@dataclass(frozen=True)
class PiiFinder:
    """Windows of ``window`` characters every ``stride``; the fit takes ``sample_windows`` labelled ones at most.

    Windows further than ``reach`` characters from all triggers are scored only where a span leads to them.
    """

    window: int = 96
    stride: int = 48
    reach: int = 160
    sample_windows: int = 1_500
    embed: int = 12
    hidden: int = 20
    epochs: int = 8
    seed: int = 5

    # ---- training

    def fit(self, docs: DataFrame) -> bilstm_crf.Params | None:
        """Parameters of the network, or None where no text holds a labelled span.

        All texts are labelled. Each kind of span gives a fourth of the windows at most, and half as many windows
        again are without spans, taken around digits that no pattern accepts: those with the smallest hashes of
        their content, equal ones once. A first pass counts, so that a second one hands on few more than are taken.
        """
        texts = docs.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
        window = self.window

        def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for first, _, data, offsets in pieces(batch.column(0)):
                    at = triggers(data)
                    for k in np.unique(np.searchsorted(offsets, at, "right") - 1):
                        rows += _labelled(data[offsets[k] : offsets[k + 1]].tobytes().decode(), window)
                columns = list(zip(*rows, strict=True)) or [()] * 4
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["context", "start", "end", "kind"]
                )

        found = text_batches(texts).mapInArrow(tidy(label), "context string, start int, end int, kind int")
        # a row per kind
        held = {r["kind"]: r["count"] for r in found.groupBy("kind").count().collect()}
        if not any(kind >= 0 for kind in held):
            return None
        take = {k: self.sample_windows // (4 if k >= 0 else 2) for k in held}
        hashed = F.xxhash64("context", "start", "end", "kind", F.lit(self.seed))
        share = F.shiftrightunsigned(hashed, 32) / float(1 << 32)
        few = F.lit(False)
        for kind, n in held.items():
            few = few | ((F.col("kind") == kind) & (share < min(1.0, 4 * take[kind] / n)))
        order = Window.partitionBy("kind").orderBy(hashed, "context", "start", "end")
        place, most = F.row_number().over(order), F.when(F.col("kind") >= 0, self.sample_windows // 4)
        ranked = found.where(few).distinct().select("*", place.alias("place"))
        taken = ranked.where(F.col("place") <= most.otherwise(self.sample_windows // 2)).collect()
        taken.sort(key=lambda r: (r["kind"], r["place"]))
        labelled = [r for r in taken if r["kind"] >= 0]
        trained = self._train(labelled, [r for r in taken if r["kind"] < 0]) if labelled else None
        release()
        return trained

    def _train(self, labelled: list, plain: list) -> bilstm_crf.Params:
        rng = np.random.default_rng(self.seed)
        rows = []
        for again in range(3):
            for r in labelled:
                text, a, b, kind = r["context"], r["start"], r["end"], r["kind"]
                if again == 2 and kind:
                    continue
                span = (text[a:b], _other_spellings(text[a:b], kind, rng), _letters_alone(text[a:b], rng))[again]
                # a window that starts anywhere before the span
                left = text[:a][-int(rng.integers(1, self.window - min(len(span), self.window // 2))) :] if a else ""
                rows.append((left + span + text[b:], len(left), len(left) + len(span), kind))
        rows += [(r["context"], 0, 0, 0) for r in plain]
        symbols = np.zeros((len(rows), self.window), np.int16)
        tags = np.zeros((len(rows), self.window), np.int8)
        lengths = np.zeros(len(rows), np.int64)
        for k, (text, a, b, kind) in enumerate(rows):
            text = text[: self.window]
            lengths[k] = max(1, len(text))
            symbols[k, : len(text)] = _symbols(text)
            if b > a:
                tags[k, a : min(b, self.window)] = 2 + 2 * kind
                tags[k, a] = 1 + 2 * kind
        start = bilstm_crf.initial(SYMBOLS, TAGS, self.embed, self.hidden, self.seed)
        return bilstm_crf.train(start, symbols, lengths, tags, self.epochs, 64, 0.01, self.seed)

    # ---- finding

    def decode(self, p: bilstm_crf.Params, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Per text the decoded spans, each of its kind's form.

        Windows within ``reach`` of a trigger are scored. Where a span goes up to the edge of what was scored,
        all windows of its text are, so that spans of any length are found as if there were no such reach.
        """
        coded = [_symbols(t) for t in texts]
        near = [self._windows(s, t) for s, t in zip(coded, texts, strict=True)]
        out, open_texts = self._decoded(p, coded, texts, near)
        if open_texts:
            every = [np.arange(self._last(len(coded[k])) + 1) for k in open_texts]
            again, _ = self._decoded(p, [coded[k] for k in open_texts], [texts[k] for k in open_texts], every)
            for k, spans in zip(open_texts, again, strict=True):
                out[k] = spans
        return out

    def _last(self, length: int) -> int:
        return max(0, -(-(length - self.window) // self.stride))

    def _windows(self, s: np.ndarray, text: str) -> np.ndarray:
        """Numbers of the windows within reach of a trigger."""
        if len(s) == 0:
            return np.zeros(0, np.int64)
        words = [m.start() for m in _AT_WORD.finditer(text)]
        at = np.append(np.flatnonzero(((s >= 17) & (s <= 26)) | (s == 33)), np.array(words, np.int64))
        last = self._last(len(s))
        first = np.maximum(0, -(-(at - self.reach - self.window + 2) // self.stride))
        end = np.minimum(last, (at + self.reach - 1) // self.stride) + 1
        edges = np.bincount(first, minlength=last + 2) - np.bincount(end, minlength=last + 2)
        return np.flatnonzero(np.cumsum(edges) > 0)

    def _decoded(
        self, p: bilstm_crf.Params, coded: list[np.ndarray], texts: list[str], windows: list[np.ndarray]
    ) -> tuple[list[list[tuple[int, int, int]]], list[int]]:
        """Spans per text, and the texts in which one goes up to an edge that is none of the text."""
        # a stretch is a run of windows that touch: (text, first window, windows)
        stretches: list[tuple[int, int, int]] = []
        apart = self.window // self.stride
        for k, own in enumerate(windows):
            if len(own):
                cuts = np.flatnonzero(np.diff(own) > apart) + 1
                stretches += [(k, int(run[0]), int(run[-1])) for run in np.split(own, cuts)]
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        open_texts: set[int] = set()
        sizes = [min(len(coded[k]), b * self.stride + self.window) - a * self.stride for k, a, b in stretches]
        order = sorted(range(len(stretches)), key=sizes.__getitem__)
        start = 0
        while start < len(order):
            end = start + 1
            while end < len(order) and end - start < 256 and sizes[order[end]] * (end - start + 1) <= 65_536:
                end += 1
            part = [stretches[j] for j in order[start:end]]
            lengths = np.array([sizes[j] for j in order[start:end]])
            scored = self._averaged(p, coded, part, windows, lengths)
            if len(part) == 1 and lengths[0] > 4_096:
                found = [bilstm_crf.viterbi_long(scored[0], p["transition"])]
            else:
                e = np.zeros((int(lengths.max()), len(part), TAGS), np.float32)
                for j, s in enumerate(scored):
                    e[: len(s), j] = s
                tags = bilstm_crf.viterbi(e, p["transition"], lengths)
                found = [tags[:n, j] for j, n in enumerate(lengths)]
            for (k, a, _), tags, n in zip(part, found, lengths.tolist(), strict=True):
                at = a * self.stride
                out[k] += _spans_of(texts[k], tags, at)
                if (tags[0] and at > 0) or (tags[-1] and at + n < len(coded[k])):
                    open_texts.add(k)
            start = end
        return [sorted(spans) for spans in out], sorted(open_texts)

    def _averaged(
        self, p: bilstm_crf.Params, coded: list, part: list[tuple[int, int, int]], windows: list, lengths: np.ndarray
    ) -> list[np.ndarray]:
        """Tag scores of some stretches, averaged over their windows; one buffer for each stretch."""
        centre = 1 + np.minimum(np.arange(self.window), np.arange(self.window)[::-1]).astype(np.float32)
        sums = [np.zeros((n, TAGS), np.float32) for n in lengths]
        weight = [np.zeros(n, np.float32) for n in lengths]
        jobs = []
        for j, (k, a, b) in enumerate(part):
            own = windows[k]
            jobs += [(j, k, int(w)) for w in own[np.searchsorted(own, a) : np.searchsorted(own, b, "right")]]
        for start in range(0, len(jobs), 256):
            some = jobs[start : start + 256]
            symbols = np.zeros((self.window, len(some)), np.int16)
            held = np.zeros(len(some), np.int64)
            for c, (_, k, w) in enumerate(some):
                s = coded[k][w * self.stride : w * self.stride + self.window]
                symbols[: len(s), c] = s
                held[c] = len(s)
            e = bilstm_crf.scores(p, symbols, held)
            for c, (j, _, w) in enumerate(some):
                n, at = int(held[c]), (w - part[j][1]) * self.stride
                sums[j][at : at + n] += e[:n, c] * centre[:n, None]
                weight[j][at : at + n] += centre[:n]
        for s, w in zip(sums, weight, strict=True):
            s /= w[:, None]
        return sums

    def find(self, docs: DataFrame, params: bilstm_crf.Params | None, out: str) -> DataFrame:
        """``docs`` with all columns and ``out``: base and added spans as (kind, start, end, added), by start.

        Positions are code points, ends exclusive. A missing text is an empty one and has none.
        """
        shared = docs.sparkSession.sparkContext.broadcast(params)  # some 30 KB
        column = docs.columns.index("text")
        struct = T.StructType(
            [
                T.StructField("kind", T.IntegerType()),
                T.StructField("start", T.LongType()),
                T.StructField("end", T.LongType()),
                T.StructField("added", T.BooleanType()),
            ]
        )
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = shared.value
            for batch in batches:
                found: list[list] = [[] for _ in range(batch.num_rows)]
                for first, _, data, offsets in pieces(batch.column(column)):
                    at = triggers(data)
                    touched = np.unique(np.searchsorted(offsets, at, "right") - 1)
                    texts = [data[offsets[k] : offsets[k + 1]].tobytes().decode() for k in touched]
                    decoded = self.decode(p, texts) if p is not None and texts else [[]] * len(texts)
                    for k, text, more in zip(touched.tolist(), texts, decoded, strict=True):
                        found[first + k] = united(base_spans(text), more)
                rows = [[dict(zip(("start", "end", "kind", "added"), s, strict=True)) for s in r] for r in found]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], [*batch.schema.names, out])

        field = T.StructField(out, T.ArrayType(struct))
        return text_batches(docs).mapInArrow(tidy(run), T.StructType([*docs.schema.fields, field]))

    def report(self, docs: DataFrame) -> DataFrame:
        """One row per document: doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, all spans."""
        texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        found = self.find(texts, self.fit(docs), "found")

        def joined(spans):
            names = F.array(*map(F.lit, KINDS))
            one = F.transform(
                spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
            )
            return F.array_join(one, ",")

        base = F.filter("found", lambda s: ~s["added"])

        def count_of(kind: int):
            return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint")

        counts = [count_of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
        return found.select(
            "doc_id",
            *counts,
            F.sha2(joined(base), 256).alias("base_sha256"),
            joined(F.col("found")).alias("spans"),
            F.size(F.filter("found", lambda s: s["added"])).cast("bigint").alias("n_added"),
        )

    def redact(self, docs: DataFrame) -> DataFrame:
        """``docs`` with every span replaced by its kind in angle brackets; other texts stay as they are.

        Where spans of two kinds overlap, the one that starts first names the whole stretch.
        """
        out = free_name(docs, "_pii")
        at, columns = docs.columns.index("text"), len(docs.columns)
        found = self.find(docs, self.fit(docs), out)

        def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, spans = batch.column(at), batch.column(columns)
                lengths = np.diff(np.asarray(spans.offsets))
                if lengths.any():
                    values = texts.to_pylist()
                    for k in np.flatnonzero(lengths).tolist():
                        values[k] = redacted(values[k], [(s["start"], s["end"], s["kind"]) for s in spans[k].as_py()])
                    texts = pa.array(values, texts.type)
                kept = list(batch.columns[:columns])
                kept[at] = texts
                yield pa.RecordBatch.from_arrays(kept, batch.schema.names[:columns])

        return found.mapInArrow(tidy(replace), docs.schema)


def _labelled(text: str, window: int) -> list[tuple[str, int, int, int]]:
    """(context, start, end, kind) around every base span that meets no other; kind -1 around other digits."""
    if not re.search("[0-9@]", text):
        return []
    spans, out = base_spans(text), []
    for j, (a, b, kind) in enumerate(spans):
        alone = (j == 0 or spans[j - 1][1] + 4 < a) and (j + 1 == len(spans) or spans[j + 1][0] > b + window)
        if alone and b - a <= window // 2:
            left = max(0, a - window, spans[j - 1][1] if j else 0)
            out.append((text[left : b + window], a - left, b - left, kind))
    covered = [(a - window, b + window) for a, b, _ in spans]
    for m in re.finditer(r"[0-9][0-9A-Za-z=-]*", text):
        if not any(a < m.end() and m.start() < b for a, b in covered):
            left = max(0, m.start() - window // 2)
            out.append((text[left : left + window], 0, 0, -1))
            covered.append((left - window, left + 2 * window))
    return out


def _spans_of(text: str, tags: np.ndarray, at: int) -> list[tuple[int, int, int]]:
    """Well-formed spans of a decoded stretch that begins at ``at``."""
    out, start, kind = [], -1, -1
    for i, t in enumerate([*tags.tolist(), 0]):
        begins, inside = t % 2 == 1, t > 0 and t % 2 == 0
        if start >= 0 and not (inside and (t - 2) // 2 == kind):
            a, b = at + start, at + i
            while a < b and not (text[a].isalnum() or text[a] in "+("):
                a += 1
            while a < b and not text[b - 1].isalnum():
                b -= 1
            if well_formed(text[a:b], KINDS[kind]):
                out.append((a, b, kind))
            start = -1
        if begins:
            start, kind = i, (t - 1) // 2
    return out


def united(base: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bool]]:
    """Base spans and those added ones that meet none of them, by start and kind."""
    out = [(a, b, k, False) for a, b, k in base]
    j = 0
    by_start = sorted(base)
    reach = -1
    for a, b, k in sorted(more):
        while j < len(by_start) and by_start[j][0] < b:
            reach = max(reach, by_start[j][1])
            j += 1
        if reach <= a:
            out.append((a, b, k, True))
    return sorted(out, key=lambda s: (s[0], s[2], s[3]))


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def base_digest(text: str | None) -> str:
    """The digest of the base spans as ``report`` gives it."""
    return hashlib.sha256(listed(base_spans(text or "")).encode()).hexdigest()
