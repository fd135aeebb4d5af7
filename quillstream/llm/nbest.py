"""SentencePiece N-best segmentation: forward Viterbi, backward A* search, and decoding.

The lattice of a text holds every piece of the vocabulary at every place; a character that is no
piece is an unknown of its UTF-8 byte pieces with the least score minus 10. A segmentation's
score is the sum of its pieces' stored scores. Forward Viterbi gives the best score of every
prefix, which is the exact heuristic of an A* search from the end: the open list never needs
more than N entries, and hypotheses come out best first. Of equal scores those come first whose
pieces are longer, read from the end.

No piece crosses the start of a word (pieces hold the space sign only in front or alone), so a
text's lattice falls apart at spaces, and further wherever no piece holds the two characters at
hand. For every distinct word, forward and backward scores give its best path and the exact loss
of its second best. In a text's N best only words can change whose second best is among the
N - 1 least losses; the A* search runs for these, and the N best are made from theirs, the fewer
words changed first, then in the order of (loss, place).

Spaces become the sign U+2581 with one put in front, and nothing else is normalised, as in models
with identity normalisation; decoding gives the text back (a literal U+2581 comes back as a
space). Null texts and empty texts have one segmentation, with no ids and score 0. Texts with
fewer than N segmentations give as many as they have. Repeated rows are repeated in the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import _powers, chunk_sums, mix64
from quillstream.llm.tokens import _spread, _Table

SPACE = "▁"
_WORDS = re.compile(r"(?<=[^ ])(?= )")
_OPEN: dict[tuple[str, int], "Segmenter"] = {}


def segmenter(path: str, n: int) -> "Segmenter":
    """The process-wide segmenter of a model file."""
    if (path, n) not in _OPEN:
        _OPEN[path, n] = Segmenter.from_model(path, n)
    return _OPEN[path, n]


class Segmenter:
    """N-best segmentation over pieces (piece -> (id, score)) and byte pieces (byte -> id)."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int] | None, unknown_id: int, n: int, keep: int = 1_500_000):
        self.pieces, self.byte_ids, self.unknown_id, self.n, self.keep = pieces, byte_ids, unknown_id, n, keep
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min((s for _, s in pieces.values()), default=0.0) - 10.0
        self.pairs = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece holds the space sign inside; words can't be parted")
        size = max([i for i, _ in pieces.values()] + (byte_ids or []) + [unknown_id]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for p, (i, _) in pieces.items():
            self.bytes_of[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(byte_ids or []):
            self.bytes_of[i] = bytes([b])
        ends = [p.encode("utf-32-le") for p in pieces]
        hashes = [mix64(np.frombuffer(p, dtype="<u4").astype(np.uint64) + np.uint64(1)) for p in ends]
        keys = np.array([(h * _powers(len(h))[0][: len(h)]).sum() + np.uint64(len(h)) for h in hashes], dtype=np.uint64)
        self._piece_table = _Table()
        self._piece_table.add(mix64(keys) | np.uint64(1), np.arange(len(pieces), dtype=np.int32))
        self._piece_score = np.array([v for _, v in pieces.values()])
        self._piece_id = np.array([i for i, _ in pieces.values()])
        self._pool = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self._size = np.array([len(x) for x in self.bytes_of])
        self._start = np.cumsum(self._size) - self._size
        self._forget()

    @classmethod
    def from_model(cls, path: str, n: int) -> "Segmenter":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids = {}, {}
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i)):
                pieces[sp.id_to_piece(i)] = (i, sp.get_score(i))
        return cls(pieces, [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else None, sp.unk_id(), n)

    # --- one part -------------------------------------------------------------------------

    def _unknown_ids(self, char: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[b] for b in char.encode()) if self.byte_ids else (self.unknown_id,)

    def _ids_of(self, part: str, cuts: list[int]) -> tuple[int, ...]:
        out: tuple[int, ...] = ()
        for a, b in zip([0, *cuts], [*cuts, len(part)]):
            got = self.pieces.get(part[a:b])
            out += (got[0],) if got else self._unknown_ids(part[a:b])
        return out

    def _lattice(self, part: str) -> tuple[list[float], list[list]]:
        """Best score of every prefix, and for every place its edges in, (score through, begin, score)."""
        size, get, longest = len(part), self.pieces.get, self.longest
        best: list[float] = [0.0] * (size + 1)
        into: list[list] = [[]]
        for i in range(1, size + 1):
            edges = []
            for j in range(i - longest if i > longest else 0, i):
                got = get(part[j:i])
                if got:
                    edges.append((best[j] + got[1], j, got[1]))
            if not edges or edges[-1][1] != i - 1:
                edges.append((best[i - 1] + self.unknown, i - 1, self.unknown))
            best[i] = max(edges)[0]
            into.append(edges)
        return best, into

    def search(self, part: str) -> list[tuple[float, tuple[int, ...]]]:
        """The N best (score, ids) of a part, best first.

        Open hypotheses are leaves of the search tree, kept in the order of its branches (the lower
        cut first), which is the order of equal scores; cuts are linked, so a step costs the same
        however long the part is.
        """
        best, into = self._lattice(part)
        # an entry: -(score of its best completion), node, suffix score, (cut, cuts after it)
        open_: list[tuple] = [(-best[-1], len(part), 0.0, None)]
        done: list[tuple[float, tuple[int, ...]]] = []
        while open_:
            at = min(range(len(open_)), key=lambda k: open_[k][0])
            _, node, suffix, link = open_[at]
            if node == 0:
                cuts = []
                while link:
                    cuts.append(link[0])
                    link = link[1]
                done.append((suffix, self._ids_of(part, [j for j in cuts if j])))
                del open_[at]
                if len(done) == self.n:
                    break
                continue
            open_[at : at + 1] = [(-(total + suffix), j, suffix + score, (j, link)) for total, j, score in into[node]]
            room = self.n - len(done)
            if len(open_) > room:
                keep = sorted(range(len(open_)), key=lambda k: open_[k][0])[:room]  # stable: ties by branch
                open_ = [open_[k] for k in sorted(keep)]
        return done

    def _loose(self, part: str) -> list[int]:
        """Places of a part that no piece of its lattice crosses."""
        size, get, longest = len(part), self.pieces.get, self.longest
        out, reach = [], 0
        for j in range(size):
            if j and reach <= j:
                out.append(j)
            for i in range(min(size, j + longest), max(reach, j + 1), -1):
                if get(part[j:i]):
                    reach = i
                    break
        return out

    def search_all(self, parts: list[str]) -> list[list[tuple[float, tuple[int, ...]]]]:
        """:meth:`search` of many parts; those of equal length, up to 48, go side by side."""
        out: list = [None] * len(parts)
        groups: dict[int, list[int]] = {}
        for k, part in enumerate(parts):
            groups.setdefault(len(part) if len(part) <= 48 else 0, []).append(k)
        for k in groups.pop(0, ()):
            out[k] = self.search(parts[k])
        for size, members in groups.items():
            for a in range(0, len(members), 8192):
                mine = members[a : a + 8192]
                for k, found in zip(mine, self._side_by_side([parts[k] for k in mine], size)):
                    out[k] = found
        return out

    def _edges(self, parts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
        """[part, i, l]: score, and number or -1, of the piece of l + 1 characters that ends at i."""
        g, width = len(parts), min(size, self.longest)
        points = np.frombuffer("".join(parts).encode("utf-32-le"), dtype="<u4").reshape(g, size).astype(np.uint64)
        up, down = _powers(size + 1)
        sums = np.zeros((g, size + 1), np.uint64)
        np.cumsum(mix64(points + np.uint64(1)) * up[:size], axis=1, out=sums[:, 1:])
        edge, number = np.full((g, size + 1, width), -np.inf), np.full((g, size + 1, width), -1, np.int32)
        for l in range(1, width + 1):
            keys = mix64((sums[:, l:] - sums[:, : size + 1 - l]) * down[: size + 1 - l] + np.uint64(l)) | np.uint64(1)
            row = self._piece_table.find(keys.ravel()).reshape(keys.shape)
            number[:, l:, l - 1] = row
            edge[:, l:, l - 1] = np.where(row >= 0, self._piece_score[row], -np.inf if l > 1 else self.unknown)
        return edge, number

    @staticmethod
    def _forward(edge: np.ndarray, size: int) -> np.ndarray:
        """Best score of every prefix, shifted by the width (nothing ends before 0)."""
        g, _, width = edge.shape
        best = np.full((g, size + 1 + width), -np.inf)
        best[:, width] = 0
        for i in range(1, size + 1):
            best[:, width + i] = (best[:, i : i + width][:, ::-1] + edge[:, i]).max(axis=1)
        return best

    def _best_two(self, parts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Best score, loss of the second best (inf without one) and ids of the best, of each part.

        Any other path has an edge off the best path, so the second best is the best path through
        such an edge: its prefix's score, its own and its suffix's.
        """
        g, width = len(parts), min(size, self.longest)
        edge, number = self._edges(parts, size)
        best = self._forward(edge, size)
        after = np.full((g, size + 1), -np.inf)
        after[:, size] = 0
        for i in range(size, 0, -1):
            for l in range(1, min(i, width) + 1):
                np.maximum(after[:, i - l], edge[:, i, l - 1] + after[:, i], out=after[:, i - l])
        rows, at = np.arange(g), np.full(g, size)
        cut = np.zeros((g, size + 1), bool)
        through = np.full(edge.shape, -np.inf)
        for i in range(1, size + 1):
            through[:, i] = best[:, i : i + width][:, ::-1] + edge[:, i] + after[:, i, None]
        while (at > 0).any():
            go = at > 0
            r, i = rows[go], at[go]
            cut[r, i] = True
            step = np.arange(1, width + 1)
            into = np.where(i[:, None] >= step, best[r[:, None], width + np.maximum(i[:, None] - step, -width)] + edge[r, i], -np.inf)
            l = width - 1 - into[:, ::-1].argmax(axis=1)  # of equal scores the longest piece
            through[r, i, l] = -np.inf
            at[go] = i - l - 1
        total = best[:, width + size]
        loss = total - through.reshape(g, -1).max(axis=1)
        who, end = np.nonzero(cut)
        begin = np.append(0, end[:-1])
        begin[np.append(True, who[1:] != who[:-1])] = 0
        piece = number[who, end, end - begin - 1]
        ids, odd = self._piece_id[piece].astype(np.uint32), np.unique(who[piece < 0])
        out = np.split(ids, np.cumsum(cut.sum(axis=1))[:-1])
        for k in odd.tolist():
            out[k] = np.array(self._ids_of(parts[k], np.flatnonzero(cut[k])[:-1].tolist()), dtype=np.uint32)
        return total, loss, out

    def _side_by_side(self, parts: list[str], size: int) -> list[list[tuple[float, tuple[int, ...]]]]:
        n, g, width = self.n, len(parts), min(size, self.longest)
        edge, _ = self._edges(parts, size)
        best = self._forward(edge, size)
        cost = np.full((g, n), np.inf)
        mask, node, suffix = np.zeros((g, n), np.int64), np.zeros((g, n), np.int64), np.zeros((g, n))
        cost[:, 0], node[:, 0] = -best[:, width + size], size
        found: list[list] = [[] for _ in range(g)]
        live, count = np.arange(g), np.zeros(g, np.int64)
        steps = np.arange(1, width + 1)
        while len(live):
            r = np.arange(len(live))
            at, m, c = node[:, 0], mask[:, 0], suffix[:, 0]  # slots are kept in order: the first is the best
            ended = np.flatnonzero(at == 0)
            count[live[ended]] += 1
            for k, score, cuts in zip(live[ended].tolist(), c[ended].tolist(), m[ended].tolist()):
                found[k].append((score, cuts))
            go = at[:, None] - steps
            into = edge[live, at]
            total = np.where(go >= 0, best[live[:, None], width + np.maximum(go, -width)] + into, -np.inf)
            cost[:, 0] = np.inf
            every_cost = np.concatenate([cost, np.where(at[:, None] > 0, -(total + c[:, None]), np.inf)], axis=1)
            every_mask = np.concatenate([mask, m[:, None] | np.where(go > 0, np.int64(1) << np.maximum(go, 0), 0)], axis=1)
            order = np.lexsort((every_mask, every_cost), axis=1)[:, :n]
            pick = (r[:, None], order)
            cost, mask = every_cost[pick], every_mask[pick]
            node = np.concatenate([node, go], axis=1)[pick]
            suffix = np.concatenate([suffix, c[:, None] + into], axis=1)[pick]
            more = np.isfinite(cost[:, 0]) & (count[live] < n)
            live, cost, mask, node, suffix = live[more], cost[more], mask[more], node[more], suffix[more]
        out = []
        for part, got in zip(parts, found):
            out.append([(score, self._ids_of(part, [j for j in range(1, size) if m >> j & 1])) for score, m in got])
        return out

    def _combine(self, lists: list[list[tuple[float, tuple[int, ...]]]]) -> list[tuple[float, tuple[int, ...]]]:
        """The N best of parts laid end to end."""
        if len(lists) == 2 and len(lists[1]) == 1:
            more, tail = lists[1][0]
            return [(score + more, ids + tail) for score, ids in lists[0]]
        items = sorted((x[0][0] - x[k][0], i, k) for i, x in enumerate(lists) for k in range(1, len(x)))[: self.n - 1]
        base = sum(x[0][0] for x in lists)
        out = []
        for change in changes(items, self.n):
            pick = {i: k for _, i, k in change}
            ids = tuple(v for i, x in enumerate(lists) for v in x[pick.get(i, 0)][1])
            out.append((base - sum(d for d, _, _ in change), ids))
        return out

    def words(self, chunks: list[str]) -> list[list[tuple[float, tuple[int, ...]]]]:
        """The N best of words with their spaces (as signs)."""
        if len(self._parts) >= 20_000:
            self._parts.clear()
        pairs, held, split = self.pairs, self._parts, []
        for chunk in chunks:
            cut = [k for k in range(1, len(chunk)) if chunk[k - 1 : k + 1] not in pairs] if len(chunk) <= 48 else self._loose(chunk)
            split.append([chunk[a:b] for a, b in zip([0, *cut], [*cut, len(chunk)])] if cut else [chunk])
        new = list({x for parts in split for x in parts if x not in held})
        held.update(zip(new, self.search_all(new)))
        return [held[x[0]] if len(x) == 1 else self._combine([held[y] for y in x]) for x in split]

    # --- whole texts ----------------------------------------------------------------------

    def _forget(self) -> None:
        self._parts: dict[str, list] = {}
        self._table, self._held = _Table(), 0
        self._best, self._loss = np.zeros(1 << 12), np.zeros(1 << 12)
        self._at, self._len = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self._ids, self._used = np.zeros(1 << 14, np.uint32), 0

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Best segmentation of distinct words and the loss of their second best."""
        need = self._held + len(words)
        while len(self._best) < need:
            self._best, self._loss, self._at, self._len = (np.concatenate([x, np.zeros_like(x)]) for x in (self._best, self._loss, self._at, self._len))
        groups: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            groups.setdefault(len(word) if len(word) <= 48 else 0, []).append(k)
        made: list = [None] * len(words)
        for k in groups.pop(0, ()):
            got = self.words([words[k]])[0]
            loss = got[0][0] - got[1][0] if len(got) > 1 else np.inf
            self._best[self._held + k], self._loss[self._held + k], made[k] = got[0][0], loss, np.array(got[0][1], dtype=np.uint32)
        for size, members in groups.items():
            for a in range(0, len(members), 4096):
                mine = members[a : a + 4096]
                total, loss, ids = self._best_two([words[k] for k in mine], size)
                at = self._held + np.array(mine)
                self._best[at], self._loss[at] = total, loss
                for k, x in zip(mine, ids):
                    made[k] = x
        size = np.array([len(x) for x in made])
        base, self._used = self._used, self._used + int(size.sum())
        while len(self._ids) < self._used:
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        self._ids[base : self._used] = np.concatenate(made)
        self._at[self._held : need], self._len[self._held : need] = base + np.cumsum(size) - size, size
        self._table.add(keys, np.arange(self._held, need, dtype=np.int32))
        self._held = need

    def segment(self, texts: list[str | None]) -> list[list[tuple[float, np.ndarray]]]:
        """The N best (score, ids) of each text."""
        out: list = [[(0.0, np.zeros(0, np.uint32))]] * len(texts)
        full = [k for k, x in enumerate(texts) if x]
        if not full:
            return out
        coded = [(" " + texts[k].replace(SPACE, " ")).encode() for k in full]
        raw = np.frombuffer(b"".join(coded), dtype=np.uint8)
        length = np.array([len(x) for x in coded])
        ends_of = np.cumsum(length)
        space = raw == 32
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[ends_of - length] = True
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(raw))
        data = raw.tobytes()
        keys = mix64(chunk_sums(raw, begin, end)) | np.uint64(1)
        row = self._table.find(keys)
        new = np.flatnonzero(row < 0)
        if len(new):
            fresh, at = np.unique(keys[new], return_index=True)
            new = new[at]
            if self._held + len(fresh) > self.keep:
                self._forget()
                fresh, new = np.unique(keys, return_index=True)
            self._learn(fresh, [data[a:b].decode().replace(" ", SPACE) for a, b in zip(begin[new].tolist(), end[new].tolist())])
            row = self._table.find(keys)
        edge = np.searchsorted(begin, ends_of, side="left")
        a = 0
        for k, b in zip(full, edge.tolist()):
            out[k] = self._text(row[a:b], lambda i, a=a: data[begin[a + i] : end[a + i]].decode().replace(" ", SPACE))
            a = b
        return out

    def _text(self, row: np.ndarray, word_at) -> list[tuple[float, np.ndarray]]:
        """The N best of a text, given its words' rows and a way to a word's characters.

        Only words whose second best is among the n - 1 least losses can be changed in the N
        best, so only theirs are searched for alternatives.
        """
        base = float(self._best[row].sum())
        loss, want = self._loss[row], self.n - 1
        start, size = self._at[row], self._len[row]
        items: list[tuple[float, int, int]] = []
        lists: dict[int, list] = {}
        if want:
            limit = np.partition(loss, want - 1)[want - 1] if want < len(loss) else np.inf
            near = np.flatnonzero((loss <= limit) & np.isfinite(loss))
            near = near[np.argsort(loss[near], kind="stable")][:want]  # ties: the earlier place first
            for i, got in zip(near.tolist(), self.words([word_at(i) for i in near.tolist()])):
                lists[i] = got
                items += [(got[0][0] - got[k][0], i, k) for k in range(1, len(got))]
            items.sort()
        out = []
        for change in changes(items, self.n):
            if not change:
                out.append((base, self._ids[_spread(start, size)]))
                continue
            parts, a = [], 0
            for _, i, k in sorted(change, key=lambda x: x[1]):
                parts += [self._ids[_spread(start[a:i], size[a:i])], np.array(lists[i][k][1], dtype=np.uint32)]
                a = i + 1
            out.append((base - sum(d for d, _, _ in change), np.concatenate([*parts, self._ids[_spread(start[a:], size[a:])]])))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text that ids stand for: bytes of the pieces without the first space."""
        ids = ids.astype(np.int64)
        data = self._pool[_spread(self._start[ids], self._size[ids])].tobytes()
        return data[1:] if data[:1] == b" " else data


def changes(items: list[tuple[float, int, int]], n: int) -> list[tuple]:
    """The n least sets of changes, at most one at a place; items are (loss, place, which), sorted.

    Only the first n - 1 items can matter: each of them alone is a better set than any with a
    later item. Sets are met best first: of a set (its items' numbers, ascending) come the one with
    the next item more and the one with its last item exchanged for the next.
    """
    items = items[: n - 1]
    if len(items) == n - 1 and (n <= 3 or items[0][0] + items[1][0] >= items[-1][0]):
        return [(), *[(x,) for x in items]]  # no two changes are better than the last alone
    loss = [d for d, _, _ in items]
    out: list[tuple] = []
    open_: list[tuple[float, int, tuple[int, ...]]] = [(0.0, 0, ())]
    while open_ and len(out) < n:
        _, size, mine = heappop(open_)
        apart = len({items[k][1] for k in mine}) == size
        if apart:
            out.append(tuple(items[k] for k in mine))
        after = mine[-1] + 1 if mine else 0
        if after < len(items):
            if mine:
                other = (*mine[:-1], after)
                heappush(open_, (sum(loss[k] for k in other), size, other))
            if apart:
                more = (*mine, after)
                heappush(open_, (sum(loss[k] for k in more), size + 1, more))
    return out


def segment(docs: DataFrame, model: str, n: int = 3, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row a segmentation: id, rank (from 0), score, ids (binary: little-endian unsigned 32-bit).

    ``with_text`` adds ``decoded``, as :func:`decode` would, in the same pass.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 250):
                batch = whole.slice(at, 250)
                index, rank, score, ids = [], [], [], []
                for k, found in enumerate(segmenter(model, n).segment(batch.column(1).to_pylist())):
                    for r, (s, x) in enumerate(found):
                        index.append(k)
                        rank.append(r)
                        score.append(s)
                        ids.append(x.astype("<u4").tobytes())
                arrays = [batch.column(0).take(pa.array(index)), pa.array(rank, pa.int32()), pa.array(score, pa.float64()), pa.array(ids, pa.binary())]
                if with_text:
                    own = segmenter(model, n)
                    arrays.append(pa.array([own.decode(np.frombuffer(x, dtype="<u4")).decode("utf-8", "replace") for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "rank", "score", "ids", *["decoded"] * with_text])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, rank int, score double, ids binary" + ", decoded string" * with_text)


def decode(rows: DataFrame, model: str, *, ids_col: str = "ids") -> DataFrame:
    """``rows`` with the column ``decoded``: the text of ids (bytes that aren't UTF-8 are replaced)."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                own = segmenter(model, 1)
                texts = [None if x is None else own.decode(np.frombuffer(x, dtype="<u4")).decode("utf-8", "replace") for x in batch.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, kinds + ", decoded string")


def digest(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and checksums of segmentations and of what they decode to."""
    return rows.select(
        id_col, "rank", "score", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"),
        F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"),
    )
