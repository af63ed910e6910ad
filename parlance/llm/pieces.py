"""SentencePiece encoding and decoding: exact N-best segmentation over the piece lattice."""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from array import array
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

#: The mark that stands for a space.
SPACE = "▁"
#: Distinct chunks whose best segmentations a Python worker keeps.
CHUNKS_KEPT = 400_000
#: Distinct chunks of which it keeps several segmentations.
MORE_KEPT = 50_000
#: Characters of chunks that a worker keeps.
CHARS_KEPT = 16_000_000
#: Longer chunks are solved one by one instead of many at once, by the same rules.
LONGEST_CHUNK = 40
#: What stands for a ``SPACE`` that the text itself has. It can't be in a column's text, and bytes spell it.
OWN_MARK = "\udc81"
#: The shift of Zipf's law, 1 / (rank + shift).
SHIFT = 2.7
#: Scores are multiples of this, so that their sums are exact in any order.
GRAIN = 2.0**-20


def default_model() -> str:
    """The installed public model's place; any other model's path can be given instead."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


_LETTERS = "A-Za-z\u00c0-\u024f"


class Pieces:
    """The vocabulary of a model file, its lattice search and its decoding.

    A text gets a space in front, spaces become ``SPACE``, and nothing else is
    changed, so that decoding gives the text back; a ``SPACE`` of the text's
    own is spelled in bytes. No piece goes on from a non-space to a space, so
    the lattice falls into chunks (one for each word with the spaces before it,
    one for each character that only bytes can spell); the lattice's N best
    paths are the N best sums of chunk paths.

    Scores are log-probabilities of single pieces. A unigram model's file has
    them. A BPE model's file has minus the merge's rank instead, of which sums
    mean nothing; a piece of rank r then has Zipf's probability, in proportion
    to 1 / (r + SHIFT), since merges are ranked by how often they occur. Pieces
    without a rank (bytes, runs of spaces) come after the last one. Nothing is
    trained, and ids are the file's own; the best path is the most probable
    segmentation, which isn't always the one that merging would give.
    """

    def __init__(self, model: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.piece, self.text, self.byte = {}, {}, {}
        raw: dict[int, float] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.text[i], raw[i] = piece, float(sp.get_score(i))
        ranked = [s for s in raw.values() if s > -1e8]
        if all(s.is_integer() and s <= 0 for s in ranked):
            last = max(-s for s in ranked) + 1
            place = {i: min(-s, last) + SHIFT for i, s in raw.items()}
            total = math.log(sum(1 / r for r in place.values()) + len(self.byte) / (last + SHIFT))
            scores, least = {i: -math.log(r) - total for i, r in place.items()}, -math.log(last + SHIFT) - total
        else:
            scores, least = {i: max(s, min(ranked)) for i, s in raw.items()}, min(ranked)
        grain = lambda s: round(s / GRAIN) * GRAIN
        #: What a byte scores where no piece has a character.
        self.byte_score = grain(least)
        self.piece = {piece: (grain(scores[i]), i) for i, piece in self.text.items()}
        self.spelling = {i: t.replace(SPACE, " ").encode() for i, t in self.text.items()} | {i: bytes([b]) for b, i in self.byte.items()}
        self.longest = max(map(len, self.piece))
        self.single = frozenset(p for p in self.piece if len(p) == 1)
        self.apart = not any(re.search(f"[^{SPACE}]{SPACE}|.\n|\n.", p, re.S) for p in self.piece)
        # stops that no piece has right after a letter end a chunk too: fewer distinct chunks
        stops = [c for c in ".,!?;:|" if not any(re.search(f"[{_LETTERS}]{re.escape(c)}", p) for p in self.piece)]
        ends = re.escape("".join(stops)) + SPACE + "\\n"
        self.chunk = re.compile(f"{SPACE}*[{_LETTERS}]+(?=[{ends}]|$)|{SPACE}*[^{SPACE}\\n]+|{SPACE}+|\\n")
        self._trie()
        self._forget()

    def _trie(self) -> None:
        """The pieces as a trie in arrays: ``step[node, class of a character]``, ``node_score``, ``node_id``."""
        chars = sorted({c for p in self.piece for c in p})
        self.cls = np.zeros(0x110000, np.int32)
        self.cls[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        go: dict[tuple[int, int], int] = {}
        score, ids = [np.nan], [-1]
        for p, (s, i) in self.piece.items():
            at = 0
            for c in p:
                k = (at, int(self.cls[ord(c)]))
                if k not in go:
                    go[k] = len(score)
                    score.append(np.nan)
                    ids.append(-1)
                at = go[k]
            score[at], ids[at] = s, i
        self.width = len(chars) + 1
        keys = np.array([a * self.width + c for a, c in go], np.int64)
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.array(list(go.values()), np.int32)[order]
        self.node_score, self.node_id = np.array(score), np.array(ids, np.int32)
        # a direct table for the classes with the most branches
        common = np.bincount(keys % self.width).argsort()[::-1][:96]
        self.column = np.full(self.width, -1, np.int32)
        self.column[common] = np.arange(len(common))
        self.table = np.full((len(score), len(common)), -1, np.int32)
        col = self.column[self.keys % self.width]
        self.table[(self.keys // self.width)[col >= 0], col[col >= 0]] = self.next[col >= 0]

    def _step(self, node: np.ndarray, cls: np.ndarray) -> np.ndarray:
        col = self.column[cls]
        out = self.table[node, col]
        rare = np.flatnonzero(col < 0)
        if len(rare):
            k = node[rare].astype(np.int64) * self.width + cls[rare]
            at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
            out[rare] = np.where(self.keys[at] == k, self.next[at], -1)
        return out

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.n_flat = self.n_chars = 0
        self.best_score, self.gap, self.start, self.size = (np.empty(1024, k) for k in (np.float64, np.float64, np.int64, np.int32))
        self.flat = np.empty(4096, np.int32)
        self.more: dict[tuple[str, int], list] = {}

    def _room(self, words: int, ids: int) -> None:
        for name, need in (("best_score", len(self.at) + words), ("gap", len(self.at) + words), ("start", len(self.at) + words), ("size", len(self.at) + words), ("flat", self.n_flat + ids)):
            a = getattr(self, name)
            if need > len(a):
                b = np.empty(max(need, 2 * len(a)), a.dtype)
                b[: len(a)] = a
                setattr(self, name, b)

    def bytes_of(self, c: str) -> tuple[int, ...]:
        return tuple(self.byte[b] for b in (SPACE if c == OWN_MARK else c).encode("utf-8", "surrogatepass"))

    def lattice(self, chunk: str) -> tuple[array, array, array, array]:
        """The edges (begin, score, id; -1 for a character in bytes) in order of their ends, and where each end's first one is."""
        get, longest = self.piece.get, self.longest
        begin, score, ident, first = array("q"), array("d"), array("q"), array("q", [0])
        for j in range(1, len(chunk) + 1):
            for i in range(max(0, j - longest), j):
                found = get(chunk[i:j])
                if found is not None:
                    begin.append(i)
                    score.append(found[0])
                    ident.append(found[1])
            c = chunk[j - 1]
            if c not in self.single:
                begin.append(j - 1)
                score.append(self.byte_score * len(self.bytes_of(c)))
                ident.append(-1)
            first.append(len(begin))
        return begin, score, ident, first

    def paths(self, chunk: str, n: int) -> list[tuple[float, np.ndarray]]:
        """The n best (score, ids) of a chunk, best first; among equals, those found first.

        Forward, Viterbi gives each place the best score from the start, and the
        edge that it came by (the longest among equals). These scores are an
        exact heuristic for a search from the end backwards: what an entry has
        done and what is ahead of it add up to the score of a whole path. So
        going back along best edges never changes an entry's score, and such
        steps are walked instead of queued; each other edge into the walk is an
        entry of its own, for the paths that leave the walk there. An entry
        that n - found better ones stand before is never taken, so no more are
        queued. Memory is the lattice and n paths, whatever the length.
        """
        begin, score, ident, first = self.lattice(chunk)
        ahead, back = array("d", [0.0]), array("q", [-1])
        for j in range(1, len(chunk) + 1):
            top, by = -math.inf, -1
            for e in range(first[j - 1], first[j]):
                total = ahead[begin[e]] + score[e]
                if total > top:
                    top, by = total, e
            ahead.append(top)
            back.append(by)

        def walk(j: int) -> array:
            out = array("q")
            while j:
                out.append(back[j])
                j = begin[back[j]]
            out.reverse()
            return out

        def ids(path: array) -> np.ndarray:
            at, out = 0, array("i")
            for e in path:
                if ident[e] < 0:
                    out.extend(self.bytes_of(chunk[at]))
                    at += 1
                else:
                    out.append(ident[e])
                    at += len(self.text[ident[e]])
            return np.frombuffer(out, np.int32)

        # (minus the score, order of finding, path it leaves, place in that path, edge)
        queue: list[tuple[float, int, int, int, int]] = [(-ahead[-1], 0, -1, -1, -1)]
        paths: list[array] = []
        out: list[tuple[float, np.ndarray]] = []
        order = 0
        while queue and len(out) < n:
            full, _, parent, place, edge = queue.pop(0)
            if parent < 0:
                path = walk(len(chunk))
                free = len(path)
            else:
                path = walk(begin[edge])
                free = len(path)
                path.append(edge)
                path.extend(paths[parent][place + 1 :])
            paths.append(path)
            out.append((-full, ids(path)))
            wanted = n - len(out)
            if not wanted:
                break
            done = sum(score[e] for e in path[free:])
            j = begin[path[free]] if free < len(path) else len(chunk)
            for k in range(free - 1, -1, -1):
                own = path[k]
                for e in range(first[j - 1], first[j]):
                    if e != own:
                        f = -(done + score[e] + ahead[begin[e]])
                        if len(queue) < wanted or f < queue[-1][0]:
                            order += 1
                            insort(queue, (f, order, len(paths) - 1, k, e))
                            del queue[wanted:]
                done += score[own]
                j = begin[own]
        return out

    def _solve(self, chunks: list[str], n: int) -> None:
        """The forward pass for many chunks at once: best score and path, and what the second-best path costs more.

        The cost comes from the backward pass: the best path through an edge
        scores ahead + edge + behind, and the second-best path is the best one
        through any edge that isn't on the best path.
        """
        easy = []
        for c in chunks:
            self.n_chars += len(c)
            if len(c) <= LONGEST_CHUNK and self.single.issuperset(c):
                easy.append(c)
            else:
                found = self.more[(c, n)] = self.paths(c, max(n, 2))
                self._room(1, len(found[0][1]))
                k = len(self.at)
                self.at[c], self.best_score[k], self.start[k], self.size[k] = k, found[0][0], self.n_flat, len(found[0][1])
                self.gap[k] = found[0][0] - found[1][0] if len(found) > 1 else np.inf
                self.flat[self.n_flat : self.n_flat + len(found[0][1])] = found[0][1]
                self.n_flat += len(found[0][1])
                del found[max(n, 1) :]
        easy.sort(key=len)
        for b in range(0, len(easy), 16_384):
            self._solve_block(easy[b : b + 16_384])

    def _solve_block(self, words: list[str]) -> None:
        n, lens = len(words), np.array([len(w) for w in words])
        wide = int(lens[-1])
        cls = np.zeros((n, wide), np.int32)
        cls[np.arange(wide) < lens[:, None]] = self.cls[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        ahead = np.full((n, wide + 1), -np.inf)
        ahead[:, 0] = 0
        back_len, back_id = np.zeros((n, wide + 1), np.int32), np.zeros((n, wide + 1), np.int32)
        edges = []
        for i in range(wide):
            row = np.flatnonzero(lens > i)
            node = np.zeros(len(row), np.int32)
            for size in range(1, min(self.longest, wide - i) + 1):
                node = self._step(node, cls[row, i + size - 1])
                live = node >= 0
                row, node = row[live], node[live]
                if not len(row):
                    break
                s = self.node_score[node]
                is_piece = ~np.isnan(s)
                r, s, piece = row[is_piece], s[is_piece], self.node_id[node[is_piece]]
                edges.append((i, size, r, s))
                total = ahead[r, i] + s
                up = total > ahead[r, i + size]
                r = r[up]
                ahead[r, i + size], back_len[r, i + size], back_id[r, i + size] = total[up], size, piece[up]
                more = i + size < lens[row]
                row, node = row[more], node[more]
        # the best paths, from their ends
        every = np.arange(n)
        best = ahead[every, lens]
        ids, on = np.full((n, wide), -1, np.int32), np.zeros((n, wide + 1), np.int32)
        row, pos, k = every, lens.copy(), wide
        while len(row):
            k -= 1
            size = back_len[row, pos]
            ids[row, k] = back_id[row, pos]
            pos = pos - size
            on[row, pos] = size
            row, pos = row[pos > 0], pos[pos > 0]
        behind = np.full((n, wide + 1), -np.inf)
        behind[every, lens] = 0
        second = np.full(n, -np.inf)
        for i, size, r, s in reversed(edges):
            behind[r, i] = np.maximum(behind[r, i], s + behind[r, i + size])
        for i, size, r, s in edges:
            other = on[r, i] != size
            r, s = r[other], s[other]
            second[r] = np.maximum(second[r], ahead[r, i] + s + behind[r, i + size])
        counts = (ids >= 0).sum(1)
        total = int(counts.sum())
        self._room(n, total)
        k = len(self.at)
        self.best_score[k : k + n], self.gap[k : k + n], self.size[k : k + n] = best, best - second, counts
        self.start[k : k + n] = self.n_flat + np.cumsum(counts) - counts
        self.flat[self.n_flat : self.n_flat + total] = ids[ids >= 0]
        self.n_flat += total
        self.at.update(zip(words, range(k, k + n), strict=True))

    def learn(self, chunks: list[str], n: int = 1) -> np.ndarray:
        """The places of ``chunks`` in the tables, after the unknown ones have been solved."""
        if len(self.at) > CHUNKS_KEPT or self.n_chars > CHARS_KEPT or len(self.more) > MORE_KEPT:
            self._forget()
        known = self.at.get
        k = [known(c, -1) for c in chunks]
        out = np.array(k, np.int64)
        new = np.flatnonzero(out < 0)
        if len(new):
            self._solve(list({chunks[i]: None for i in new}), n)
            out[new] = [self.at[chunks[i]] for i in new]
        return out

    def kept(self, chunk: str, n: int) -> list:
        """The n best paths of a chunk."""
        found = self.more.get((chunk, n))
        if found is None:
            found = self.more[(chunk, n)] = self.paths(chunk, n)
        return found

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        marked = SPACE + text.replace(SPACE, OWN_MARK).replace(" ", SPACE)
        if not self.apart:
            return [marked]
        return self.chunk.findall(marked)

    def first(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best paths' ids of the chunks at places ``k``, in a row, and where each chunk's end there."""
        sizes = self.size[k]
        ends = np.cumsum(sizes, dtype=np.int64)
        return self.flat[np.repeat(self.start[k] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(k) else 0)], ends

    def best(self, parts: list[str], k: np.ndarray, ids: np.ndarray, ends: np.ndarray, n: int = 1) -> list[tuple[float, np.ndarray]]:
        """The n best segmentations (score, ids) of a text: its chunks, their places, its best path and the chunks' ends in it.

        Exact: the best sum takes path 0 everywhere; each further one moves one
        chunk of a found one by one path, in the order of what the moves cost.
        Only the n - 1 chunks whose second paths cost least can take part.
        """
        score = float(self.best_score[k].sum())
        out = [(score, ids)]
        if n == 1 or not len(parts):
            return out
        gap = self.gap[k]
        near = np.arange(len(gap))
        if len(gap) > n:
            near = np.flatnonzero(gap <= np.partition(gap, n - 2)[n - 2])
            near = near[np.argsort(gap[near], kind="stable")][: n - 1]
        near = [int(c) for c in near if gap[c] < np.inf]
        paths = {c: self.kept(parts[c], n) for c in near}
        heap, seen = [(0.0, ())], {()}
        while heap and len(out) <= n:
            cost, swaps = heapq.heappop(heap)
            if swaps:
                out.append((score - cost, self._swapped(ids, ends, self.size[k], {c: paths[c][r][1] for c, r in swaps})))
            now = dict(swaps)
            for c in near:
                r = now.get(c, 0) + 1
                if r < len(paths[c]):
                    nxt = tuple(sorted({**now, c: r}.items()))
                    if nxt not in seen:
                        seen.add(nxt)
                        heapq.heappush(heap, (cost + paths[c][r - 1][0] - paths[c][r][0], nxt))
        return out[:n]

    def many(self, texts: list[str], n: int) -> list[list[tuple[float, np.ndarray]]]:
        """``best`` for each of ``texts``."""
        parts = [self.chunks(t) for t in texts]
        k = self.learn([c for p in parts for c in p], n)
        ids, ends = self.first(k)
        out, c, at = [], 0, 0
        for p in parts:
            end = int(ends[c + len(p) - 1]) if p else at
            out.append(self.best(p, k[c : c + len(p)], ids[at:end], ends[c : c + len(p)] - at, n))
            c, at = c + len(p), end
        return out

    @staticmethod
    def _swapped(ids: np.ndarray, ends: np.ndarray, sizes: np.ndarray, swap: dict[int, np.ndarray]) -> np.ndarray:
        out, at = [], 0
        for c in sorted(swap):
            out += [ids[at : ends[c] - sizes[c]], swap[c]]
            at = ends[c]
        return np.concatenate([*out, ids[at:]])

    def decode(self, ids: list[int]) -> str:
        """The text of a segmentation: the pieces' bytes in a row, without the space in front."""
        return b"".join(map(self.spelling.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def pieces(model: str) -> Pieces:
    return Pieces(model)


#: Characters of text that are worked on at once.
BLOCK = 1_000_000


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0] + [len(x) for x in rows])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int32)))


def _encoded(model: str, n: int, at: int, names: list[str], others: bool):
    def block(p: Pieces, texts: list[str]) -> list:
        found = p.many(texts, n)
        rows = []
        for text, paths in zip(texts, found, strict=True):
            first = paths[0][1]
            rows.append((len(first), [round(s, 6) for s, _ in paths], [len(x) for _, x in paths], [hashlib.sha256(x.tobytes()).hexdigest() for _, x in paths], p.decode(first.tolist()) == text))
        more = []
        if others:
            ends = np.cumsum([0] + [len(x) - 1 for x in found])
            more = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _lists([ids for x in found for _, ids in x[1:]]))]
        return [_lists([x[0][1] for x in found]), *zip(*rows, strict=True)], more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        kinds = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.bool_()]
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                texts, size = [], 0
                while start + len(texts) < batch.num_rows and size < BLOCK:
                    texts.append(batch.column(at)[start + len(texts)].as_py() or "")
                    size += len(texts[-1])
                part = batch.slice(start, len(texts))
                start += len(texts)
                (ids, *cols), more = block(p, texts)
                yield pa.RecordBatch.from_arrays([*part.columns, ids, *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], *more], names)

    return run


ADDED = ("ids", "n_pieces", "scores", "path_pieces", "path_sha256", "round_trip", "others")


def encoded(docs: DataFrame, model: str | None = None, n: int = 4, text_col: str = "text", others: bool = True) -> DataFrame:
    """``docs`` with the ids, scores, sizes and digests of the n best segmentations.

    ``ids`` are the best path's piece ids and ``others`` those of the further
    paths (left out if ``others`` is false). ``scores`` are the n best scores in
    falling order (fewer where the lattice has fewer paths), ``path_pieces`` and
    ``path_sha256`` (of the ids as little-endian int32) belong to them, and
    ``round_trip`` says that decoding the best path gave the text itself back.

    A null text is the empty text: no pieces, one path of score 0. Paths of
    equal score come in the order that ``Pieces.paths`` finds them in, the same
    for equal texts. Repeated rows are encoded each; very long texts, and words
    of any length, take memory in proportion to their length; an empty table
    gives an empty one. Other columns pass through, and added columns whose
    names ``docs`` has get a number behind them.
    """
    model = model or default_model()
    added = ADDED if others else ADDED[:-1]
    new = fresh(docs.columns, *added)
    ids = T.ArrayType(T.IntegerType())
    kinds = [ids, T.LongType(), T.ArrayType(T.DoubleType()), T.ArrayType(T.LongType()), T.ArrayType(T.StringType()), T.BooleanType(), T.ArrayType(ids)]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, k) for c, k in zip(new, kinds[: len(added)], strict=True)]])
    return docs.mapInArrow(_encoded(model, n, docs.columns.index(text_col), schema.names, others), schema)


def _decoded(model: str, at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for batch in batches:
            texts = [None if x is None else p.decode(x) for x in (v.as_py() for v in batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names)

    return run


def decoded(rows: DataFrame, model: str | None = None, ids_col: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text that ``ids_col`` spells; null ids give null, no ids the empty text.

    Any segmentation of a text gives that text. An empty table gives an empty
    one, repeated rows are decoded each, and the new column gets a number if
    there is one of its name.
    """
    (text,) = fresh(rows.columns, text)
    schema = T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())])
    return rows.mapInArrow(_decoded(model or default_model(), rows.columns.index(ids_col), schema.names), schema)


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """The digests of ``encoded`` with the four best paths over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encoded(docs, others=False).drop("text")
