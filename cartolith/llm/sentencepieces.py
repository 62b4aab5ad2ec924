"""N-best SentencePiece segmentation and decoding.

A text becomes one lattice of pieces. The forward Viterbi pass gives every
position the best score from the start; these scores are exact heuristics for
a backward A* search from the end, which yields segmentations in order of
their score. No piece has a space mark after another character, so the
lattice falls apart at words. Only the N - 1 words with the smallest loss for
their second-best segmentation can differ among the N best of a text: these
words are searched; all others need their Viterbi segmentation only, which is
kept per distinct word; many new words of one length are searched together,
one array element per word.

A character without a piece of its own is an unknown node, written as byte
pieces. Decoding joins the pieces' bytes and drops the mark that was put in
front of the text.

Defined results: null and empty texts have one empty segmentation of score
zero; equal scores keep the order in which the search finds them; repeated rows are
encoded each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
N_BEST = 4
CACHE_WORDS = 800_000
#: Words whose n segmentations are kept.
KEPT_WAYS = 50_000
UNKNOWN_LOSS = 10.0
FACTOR = 0x9E3779B97F4A7C15
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Segmenter:
    def __init__(self, model_file: str, n: int = N_BEST):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.n = n
        self.pieces: dict[str, tuple[int, float, tuple[int]]] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids: dict[int, int] = {}
        for k in range(model.vocab_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                value = int(piece[1:-1], 16)
                self.byte_ids[value] = k
                self.bytes_of.append(bytes([value]))
            elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                self.bytes_of.append(b"")
            else:
                self.pieces[piece] = (k, float(model.get_score(k)), (k,))
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError("pieces with an inner space mark are not supported")
        self.longest = max(map(len, self.pieces))
        ordinary = [s for _, s, _ in self.pieces.values() if s > -1e8]
        self.unknown = min(ordinary) - UNKNOWN_LOSS
        #: Per kept word its number in the arrays below; the arrays start anew when CACHE_WORDS are kept.
        self.number: dict[str, int] = {}
        self.ways: dict[str, list[tuple[float, bytes]]] = {}
        self.ids, self.scores, self.losses = [], np.zeros(1 << 16), np.zeros(1 << 16)
        # pieces by a polynomial hash of their code points, sorted, and the scores and ids in that order
        codes = [self._hash(p) for p in self.pieces]
        if len(set(codes)) < len(codes):
            raise ValueError("two pieces share a hash")
        order = np.argsort(np.array(codes, dtype=np.uint64))
        self.codes = np.array(codes, dtype=np.uint64)[order]
        self.code_scores = np.array([v[1] for v in self.pieces.values()])[order]
        self.code_ids = np.array([v[0] for v in self.pieces.values()], dtype=np.int32)[order]
        self.letters = np.array([ord(p) + 1 for p in self.pieces if len(p) == 1], dtype=np.uint64)

    @staticmethod
    def _hash(piece: str) -> int:
        code = 0
        for c in piece:
            code = (code * FACTOR + ord(c) + 1) % (1 << 64)
        return code

    def lattice(self, word: str) -> tuple[list[list[tuple[int, float, tuple[int, ...]]]], list[float]]:
        """Edges into every position as (from, score, ids), and the forward Viterbi scores."""
        size, pieces, longest = len(word), self.pieces, self.longest
        edges: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(size + 1)]
        best = [0.0] + [-np.inf] * size
        for i in range(size):
            here = best[i]
            single = False
            for j in range(i + 1, min(i + longest, size) + 1):
                found = pieces.get(word[i:j])
                if found is not None:
                    single = single or j == i + 1
                    edges[j].append((i, found[1], found[2]))
                    if here + found[1] > best[j]:
                        best[j] = here + found[1]
            if not single:
                ids = tuple(self.byte_ids[b] for b in word[i].encode("utf-8", "replace"))
                edges[i + 1].append((i, self.unknown, ids))
                if here + self.unknown > best[i + 1]:
                    best[i + 1] = here + self.unknown
        return edges, best

    def search(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """Up to n segmentations (score, ids) of a word, best first."""
        edges, best = self.lattice(word)
        # equal priorities: the one nearer to the start first; a position's n first visits are those of its n best ends
        agenda: list[tuple[float, int, int, float, tuple | None]] = [(-best[-1], len(word), 0, 0.0, None)]
        visits = [0] * (len(word) + 1)
        out: list[tuple[float, tuple[int, ...]]] = []
        count = 0
        while agenda and len(out) < n:
            _, at, _, tail, link = heapq.heappop(agenda)
            visits[at] += 1
            if visits[at] > n:
                continue
            if at == 0:
                ids: list[int] = []
                while link is not None:
                    ids.extend(link[0])
                    link = link[1]
                out.append((tail, tuple(ids)))
                continue
            for i, score, own in edges[at]:
                count += 1
                if visits[i] < n:
                    heapq.heappush(agenda, (-(tail + score + best[i]), i, count, tail + score, (own, link)))
        return out

    def best_two(self, word: str) -> tuple[list[int], float, float]:
        """Ids and score of the best segmentation and the loss of the second best, by a forward pass with two scores per position."""
        size, get, longest, low = len(word), self.pieces.get, self.longest, -math.inf
        first, second = [0.0] + [low] * size, [low] * (size + 1)
        back: list[tuple[int, tuple[int, ...]] | None] = [None] * (size + 1)
        for i in range(size):
            one, two, single = first[i], second[i], False
            for j in range(i + 1, min(i + longest, size) + 1):
                found = get(word[i:j])
                if found is not None:
                    if j == i + 1:
                        single = True
                    score = one + found[1]
                    if score > first[j]:
                        second[j] = first[j] if first[j] > two + found[1] else two + found[1]
                        first[j], back[j] = score, (i, found[2])
                    elif score > second[j]:
                        second[j] = score
            if not single:
                score, j = one + self.unknown, i + 1
                ids = tuple(self.byte_ids[b] for b in word[i].encode("utf-8", "replace"))
                if score > first[j]:
                    second[j] = first[j] if first[j] > two + self.unknown else two + self.unknown
                    first[j], back[j] = score, (i, ids)
                elif score > second[j]:
                    second[j] = score
        ids, at = [], size
        while at:
            at, own = back[at]
            ids.extend(reversed(own))
        ids.reverse()
        return ids, first[size], first[size] - second[size]

    def best_two_of(self, words: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """best_two() of many words of one length: ids, scores and losses."""
        n, size = len(words), len(words[0])
        letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(n, size).T.astype(np.uint64) + np.uint64(1)
        first, second = np.full((size + 1, n), -np.inf), np.full((size + 1, n), -np.inf)
        first[0] = 0.0
        before, piece = np.zeros((size + 1, n), dtype=np.int16), np.zeros((size + 1, n), dtype=np.int32)
        codes, where = np.unique(letters, return_inverse=True)
        unknown = ~np.isin(codes, self.letters)[where].reshape(letters.shape)
        for i in range(size):
            code = np.zeros(n, dtype=np.uint64)
            for j in range(i + 1, min(i + self.longest, size) + 1):
                code = code * np.uint64(FACTOR) + letters[j - 1]
                at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                rows = np.flatnonzero(self.codes[at] == code)
                if not len(rows):
                    continue
                own = self.code_scores[at[rows]]
                one, two, old = first[i, rows] + own, second[i, rows] + own, first[j, rows]
                better = one > old
                second[j, rows] = np.where(better, np.maximum(old, two), np.maximum(second[j, rows], one))
                won = rows[better]
                first[j, won], before[j, won], piece[j, won] = one[better], i, self.code_ids[at[won]]
            rows = np.flatnonzero(unknown[i])
            if len(rows):
                one, two, old = first[i, rows] + self.unknown, second[i, rows] + self.unknown, first[i + 1, rows]
                better = one > old
                second[i + 1, rows] = np.where(better, np.maximum(old, two), np.maximum(second[i + 1, rows], one))
                won = rows[better]
                first[i + 1, won], before[i + 1, won], piece[i + 1, won] = one[better], i, -2 - (letters[i, won].astype(np.int32) - 1)
        every, at, found = np.arange(n), np.full(n, size), []
        while at.any():
            found.append(np.where(at > 0, piece[at, every], -1))
            at = np.where(at > 0, before[at, every], 0)
        ids = np.stack(found[::-1], axis=1)
        used = ids != -1
        ends = (2 * np.cumsum(used.sum(axis=1))).tolist()
        data = ids[used].astype("<u2").tobytes()
        parts = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        for k in np.flatnonzero((ids < -1).any(axis=1)).tolist():
            own = [(p,) if p >= 0 else [self.byte_ids[b] for b in chr(-2 - p).encode("utf-8", "replace")] for p in ids[k].tolist() if p != -1]
            parts[k] = struct.pack(f"<{sum(map(len, own))}H", *chain.from_iterable(own))
        return parts, first[size], first[size] - second[size]

    def _keep(self, words: set[str]) -> None:
        """Number new words, with their best ids, score and the loss of the second-best segmentation."""
        if len(self.number) + len(words) > CACHE_WORDS:
            self.number, self.ids = {}, []
        while len(self.ids) + len(words) > len(self.scores):
            self.scores, self.losses = np.append(self.scores, self.scores), np.append(self.losses, self.losses)
        groups: dict[int, list[str]] = {}
        for word in words:
            groups.setdefault(len(word) if len(word) <= 64 else 0, []).append(word)
        for size, own in groups.items():
            if size:
                parts, scores, losses = self.best_two_of(own)
            else:
                found = [self.best_two(w) for w in own]
                parts, scores, losses = [struct.pack(f"<{len(f[0])}H", *f[0]) for f in found], [f[1] for f in found], [f[2] for f in found]
            at = len(self.ids)
            self.number.update(zip(own, range(at, at + len(own)), strict=True))
            self.ids += parts
            self.scores[at : at + len(own)], self.losses[at : at + len(own)] = scores, losses

    def _ways(self, word: str) -> list[tuple[float, bytes]]:
        """All n segmentations of a word as (loss, ids); short words, which come again, are kept."""
        found = self.ways.get(word)
        if found is None:
            ways = self.search(word, self.n)
            found = [(ways[0][0] - score, struct.pack(f"<{len(ids)}H", *ids)) for score, ids in ways]
            if len(word) <= 64:
                if len(self.ways) >= KEPT_WAYS:
                    self.ways.clear()
                self.ways[word] = found
        return found

    def encode_all(self, texts: list[str]) -> list[list[tuple[float, bytes]]]:
        """Per text up to n segmentations as (score, ids in little-endian uint16), best first."""
        words = [WORD.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = set().union(*words).difference(self.number)
        if len(self.number) + len(new) > CACHE_WORDS:
            new = set().union(*words)
        self._keep(new)
        return [self._n_best(w) for w in words]

    def encode(self, text: str) -> list[tuple[float, bytes]]:
        return self.encode_all([text])[0]

    def _n_best(self, words: list[str]) -> list[tuple[float, bytes]]:
        if not words:
            return [(0.0, b"")]
        found = list(map(self.number.__getitem__, words))
        at = np.array(found)
        best, losses = float(self.scores[at].sum()), self.losses[at]
        k = min(self.n - 1, len(found))
        near = np.argsort(losses, kind="stable")[:k] if len(found) <= 64 else np.sort(np.argpartition(losses, k - 1)[:k])
        ways: list[tuple[float, tuple]] = [(0.0, ())]
        for at in near.tolist():
            options = self._ways(words[at])
            ways = [(loss + own, (*picks, (at, ids)) if rank else picks) for loss, picks in ways for rank, (own, ids) in enumerate(options)]
            ways = sorted(ways, key=lambda w: w[0])[: self.n]
        parts = list(map(self.ids.__getitem__, found))
        out = []
        for loss, picks in ways:
            changed = list(parts) if picks else parts
            for at, ids in picks:
                changed[at] = ids
            out.append((best - loss, b"".join(changed)))
        return out

    def decode(self, ids: bytes) -> str:
        data = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u2").tolist()))
        return data.decode("utf-8", "replace").removeprefix(" ")


@lru_cache(maxsize=1)
def segmenter_of(model_file: str, n: int) -> Segmenter:
    """One segmenter per worker process: its word caches serve all tasks that run there."""
    return Segmenter(model_file, n)


def segmented(docs: DataFrame, model: str = "piece_bpe_32k.model", n: int = N_BEST) -> DataFrame:
    """(doc_id, decoded, nbest): nbest = array of (score, ids as uint16 bytes), best first; decoded from the best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        segmenter = segmenter_of(public_tokenizers.path(model), n)
        kind = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.binary())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = segmenter.encode_all([t or "" for t in part.column(1).to_pylist()])
                decoded = [segmenter.decode(f[0][1]) for f in found]
                nbest = pa.array([[{"score": s, "ids": i} for s, i in f] for f in found], kind)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(decoded, pa.string()), nbest], ["doc_id", "decoded", "nbest"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, decoded string, nbest array<struct<score:double,ids:binary>>")


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Scores, piece counts and checksums of the N best segmentations, and the checksum of the text decoded from the best."""
    found = segmented(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id",
        F.round(F.col("nbest")[0]["score"], 3).alias("best_score"),
        (F.octet_length(F.col("nbest")[0]["ids"]) / 2).cast("long").alias("n_pieces"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.transform("nbest", lambda x: F.struct(F.round(x["score"], 3).alias("score"), (F.octet_length(x["ids"]) / 2).cast("long").alias("n_pieces"), F.crc32(x["ids"]).alias("ids_crc32"))).alias("nbest"),
    )


QUERIES = {"op6_sentencepiece": op6_sentencepiece}
SQL: dict[str, str] = {}
