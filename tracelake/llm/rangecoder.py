"""Adaptive context-mixing range coder for token ids.

Ids are coded in blocks that share nothing: every block starts with an empty model, so it
can be read alone. Many blocks are coded at once, one per lane of numpy arrays, because
the next step of a block depends on its last.

An id falls in one of four classes: the id that last followed the same two ids (order 2),
the one that last followed the same id (order 1), any other id that the block has had
(order 0), or a new one. The probability that the order-2 id is right is mixed in the
logistic domain from three predictions: what the confidences of the order-2 and of the
order-1 prediction have been worth so far, and how frequent the id is in the block (order
0), with weights that learn from every id; order-1 hits and ids of order 0 have adaptive
probabilities of their own. Among ids of order 0 the distribution is that of the block's
ids up to the last rebuild, which is at most REBUILD ids ago.
All arithmetic is on integers, so that every machine reads what another wrote.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK_IDS = 2048
TABLE_BITS = 10
SOME = 128  # lanes whose order 0 is built at a time
_P = 15  # bits of a class probability
_LOW = np.int64(1) << np.int64(32)
_RAW_BITS = 16
_FIRST, REBUILD = 16, 256  # ids before order 0 has a distribution, and after which it is renewed at the latest

# logistic tables: stretch(p) = ln(p / (1 - p)) in 1/256, for p in 1/4096, and its inverse
_p = (np.arange(4096) + 0.5) / 4096
STRETCH = np.round(256 * np.log(_p / (1 - _p))).astype(np.int32)
_SPAN = 2304
SQUASH = np.clip(np.round(32768 / (1 + np.exp(-np.arange(-_SPAN, _SPAN + 1) / 256))), 64, 32768 - 64).astype(np.int32)
#: What a confidence (of 16) changes by after a miss (halved) and after a hit (one more, up to 15).
CHANGE = np.array([(c >> 1) - c for c in range(16)] + [min(c + 1, 15) - c for c in range(16)], np.int32)


class _Lanes:
    """The models of many blocks, and one step of coding for all of them."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids  # (lanes, BLOCK_IDS), filled as far as it is known
        n = len(ids)
        self.n, self.lane = n, np.arange(n, dtype=np.int64)
        size = 1 << TABLE_BITS
        self.base = self.lane * size
        self.one = np.zeros(n * size, np.int32)  # id << 4 | confidence
        self.two = np.zeros(n * size, np.int32)
        # probabilities in 1/65536: by order-2 confidence and whether order 1 agrees, by order-1 confidence, and of order-1 hits
        self.p2, self.p1, self.hit1 = (np.full(n * 32, 1 << 15, np.int32) for _ in range(3))
        self.old = np.full(n, 1 << 15, np.int32)
        self.w2 = np.full(n, 2500, np.int32)  # of 4096
        self.w1 = np.full(n, 1625, np.int32)
        self.w0 = np.zeros(n, np.int32)
        self.zero = np.zeros(n * size, np.int32)  # counts of ids by their hash
        self.step = 0
        self.base32 = self.lane * 32
        self.a = np.zeros(n, np.int64)  # the last id and the one before
        self.b = np.zeros(n, np.int64)
        self.sorted = self.start = self.count = None
        self.total = 0

    def rebuild(self, at: int) -> None:
        """Order 0 from the first `at` ids: slot s of the sorted ids stands for one count."""
        self.sorted, self.start, self.count = (np.empty((self.n, at), t) for t in (np.uint16, np.int16, np.int16))
        slot = np.arange(at, dtype=np.int16)
        for a in range(0, self.n, SOME):
            own = np.sort(self.ids[a : min(a + SOME, self.n), :at], axis=1)
            new = np.ones(own.shape, bool)
            new[:, 1:] = own[:, 1:] != own[:, :-1]
            start = np.maximum.accumulate(np.where(new, slot, 0), axis=1)
            last = np.ones(own.shape, bool)
            last[:, :-1] = new[:, 1:]
            end = np.minimum.accumulate(np.where(last, slot + 1, at)[:, ::-1], axis=1)[:, ::-1]
            self.sorted[a : a + SOME], self.start[a : a + SOME], self.count[a : a + SOME] = own, start, end - start
        self.sorted, self.start, self.count = self.sorted.ravel(), self.start.ravel(), self.count.ravel()
        self.total = at

    def places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For ids (lanes, steps): their first slot in order 0, and whether they are there."""
        place, there = np.zeros(ids.shape, np.int16), np.zeros(ids.shape, bool)
        held = self.sorted.reshape(self.n, -1)
        for a in range(0, self.n, SOME):
            own = ids[a : a + SOME]
            lane = (np.arange(len(own), dtype=np.uint32) << np.uint32(16))[:, None]
            wide, key = (held[a : a + SOME] | lane).ravel(), own | lane
            at = np.searchsorted(wide, key)
            there[a : a + SOME] = wide[np.minimum(at, len(wide) - 1)] == key
            place[a : a + SOME] = np.where(there[a : a + SOME], at - np.arange(len(own))[:, None] * self.total, 0)
        return place, there

    def predict(self) -> None:
        a = self.a
        at1 = (a * 40503 >> 4) & ((1 << TABLE_BITS) - 1)
        at2 = ((a * 40503 ^ self.b * 60493) >> 5) & ((1 << TABLE_BITS) - 1)
        at1 += self.base
        at2 += self.base
        if self.step:
            self.zero[at1] += 1  # the last id, whose hash this is
        e1, e2 = self.one.take(at1), self.two.take(at2)
        self.at1, self.at2, self.e1, self.e2 = at1, at2, e1, e2
        self.id1, self.id2 = e1 >> 4, e2 >> 4
        self.c1, self.c2 = e1 & 15, e2 & 15
        self.agree = agree = self.id1 == self.id2
        k1 = self.base32 + self.c1
        k2 = self.base32 + self.c2
        k2 += 16 * agree
        self.k1, self.k2 = k1, k2
        self.q2, self.q1, self.qh = self.p2.take(k2), self.p1.take(k1), self.hit1.take(k1)
        self.s2, self.s1 = STRETCH.take(self.q2 >> 4), STRETCH.take(self.q1 >> 4)
        seen = self.zero.take(self.base + ((self.id2.astype(np.int64) * 40503 >> 4) & ((1 << TABLE_BITS) - 1)))
        self.s0 = STRETCH.take((np.arange(self.step + 2) * 4095) // (self.step + 1)).take(seen)
        dot = self.w2 * self.s2
        dot += self.w1 * self.s1
        dot += self.w0 * self.s0
        dot >>= 12
        pa = SQUASH.take(dot + _SPAN, mode="clip")
        edges = self.edges = np.empty((5, self.n), np.int64)
        edges[0], edges[1], edges[4] = 0, pa, 32768
        rest = 32768 - pa
        # every class that can come keeps a share; the new ids' is what is left
        pb = (((rest - 3) * (self.qh >> 4)) >> 12) + 1
        pb *= ~agree
        np.add(pa, pb, out=edges[2])
        if self.total:
            rest -= pb
            po = ((rest - 2) * (self.old >> 4)) >> 12
            po += 1
            np.add(edges[2], po, out=edges[3])
        else:
            edges[3] = edges[2]
        self.pa = pa

    def learn(self, ids: np.ndarray, kind: np.ndarray) -> None:
        hit2, hit1 = kind == 0, ids == self.id1
        bit = hit2 * np.int32(1 << 16)
        self.step += 1
        error = (bit >> 1) - self.pa
        for w, x in ((self.w2, self.s2), (self.w1, self.s1), (self.w0, self.s0)):
            w += (error * (x >> 3)) >> 14
            np.clip(w, -3500, 7500, out=w)
        self.p2[self.k2] = self.q2 + ((bit - self.q2) >> 4)
        self.p1[self.k1] = self.q1 + ((bit - self.q1) >> 4)
        self.hit1[self.k1] = self.qh + (((hit1 * np.int32(1 << 16) - self.qh) >> 4) * (~hit2 & ~self.agree))
        if self.total:
            self.old += ((((kind == 2) * np.int32(1 << 16)) - self.old) >> 5) * (kind > 1)
            np.clip(self.old, 1024, 64512, out=self.old)
        new = (ids.astype(np.int32) << 4) | 1
        for table, at, e, c, hit in ((self.two, self.at2, self.e2, self.c2, hit2), (self.one, self.at1, self.e1, self.c1, hit1)):
            after = e + CHANGE.take(c + 16 * hit)
            np.copyto(after, new, where=(c <= 1) & ~hit)
            table[at] = after
        self.b, self.a = self.a, ids

    def shrink(self, n: int) -> None:
        """Only the first n lanes go on."""
        size = 1 << TABLE_BITS
        for name, width in (("one", size), ("two", size), ("zero", size), ("w0", 1), ("p2", 32), ("p1", 32), ("hit1", 32), ("old", 1), ("w2", 1), ("w1", 1), ("a", 1), ("b", 1), ("base", 1), ("base32", 1), ("lane", 1)):
            setattr(self, name, getattr(self, name)[: n * width])
        if self.total:
            for name in ("sorted", "start", "count"):
                setattr(self, name, getattr(self, name)[: n * self.total])
        self.n = n


def _bounds(m: _Lanes, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = m.edges.ravel()  # 0, the three inner bounds, 32768: a row each
    at = kind * m.n + np.arange(m.n)
    low = edges.take(at)
    return low, edges.take(at + m.n) - low


def _rebuilds(t: int) -> bool:
    """Whether order 0 is renewed before id t: at powers of two, then every REBUILD ids."""
    return t >= _FIRST and (t % REBUILD == 0 or (t < REBUILD and t & (t - 1) == 0))


def _order(blocks_n: np.ndarray) -> np.ndarray:
    return np.argsort(-blocks_n, kind="stable")


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block's ids (uint16, at most BLOCK_IDS, at least one) as bytes."""
    sizes = np.array([len(x) for x in blocks])
    order = _order(sizes)
    ids = np.zeros((len(blocks), int(sizes.max(initial=1))), np.uint16)
    for lane, k in enumerate(order.tolist()):
        ids[lane, : sizes[k]] = blocks[k]
    lens = sizes[order]
    m = _Lanes(ids)
    n = m.n
    words = np.zeros((n, 2 * ids.shape[1] + 8), np.int32)  # an id takes less than two words
    flat, width = words.ravel(), words.shape[1]
    out = np.arange(n, dtype=np.int64) * width
    low, wide = np.zeros(n, np.int64), np.full(n, (1 << 48) - 1, np.int64)
    ends = np.zeros(0, np.int64)
    place = there = None

    def settle(k: np.ndarray) -> None:
        # a carry out of the 48 bits goes to words already written; it is added up there and settled at the end
        flat[out[k]] = low[k] >> 32
        out[k] += 1
        low[k] = (low[k] & ((1 << 32) - 1)) << 16
        wide[k] <<= 16

    for t in range(ids.shape[1]):
        live = int(np.searchsorted(-lens, -t, "left"))
        if live < m.n:
            m.shrink(live)
            _flush(flat, low[live:], out[live:])
            ends = np.concatenate((out[live:], ends))
            low, wide, out = low[:live].copy(), wide[:live].copy(), out[:live].copy()
        if _rebuilds(t):
            m.rebuild(t)
            place, there = m.places(ids[: m.n, t : min(t + min(t, REBUILD), ids.shape[1])])
            base_t = t
        own = ids[: m.n, t].astype(np.int64)
        m.predict()
        known = there[: m.n, t - base_t] if m.total else np.zeros(m.n, bool)
        kind = np.where(own == m.id2, 0, np.where(own == m.id1, 1, np.where(known, 2, 3)))
        c, f = _bounds(m, kind)
        r = wide >> _P
        low += r * c
        wide = r * f
        k = np.flatnonzero(wide < _LOW)
        settle(k)
        k = np.flatnonzero(kind >= 2)
        if len(k):
            raw = kind[k] == 3
            c, f, whole = own[k], np.ones(len(k), np.int64), np.full(len(k), 1 << _RAW_BITS, np.int64)
            if m.total:
                at = place[k, t - base_t].astype(np.int64)
                c = np.where(raw, c, at)
                f = np.where(raw, 1, m.count[m.lane[k] * m.total + at])
                whole[~raw] = m.total
            r = wide[k] // whole
            low[k] += r * c
            wide[k] = r * f
            settle(k[wide[k] < _LOW])
        m.learn(own, kind)
    _flush(flat, low, out)
    ends = np.concatenate((out, ends))
    result: list[bytes] = [b""] * len(blocks)
    for lane, k in enumerate(order.tolist()):
        row = flat[lane * width : ends[lane]]
        while len(over := np.flatnonzero(row >> 16)):
            row[over - 1] += row[over] >> 16
            row[over] &= 0xFFFF
        result[k] = row.astype("<u2").tobytes()
    return result


def _flush(flat: np.ndarray, low: np.ndarray, out: np.ndarray) -> None:
    for shift in (32, 16, 0):
        flat[out] = (low >> 32) if shift == 32 else (low >> shift) & 0xFFFF
        out += 1


def decode(payloads: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The ids of each block, from its bytes and its number of ids."""
    sizes = np.array(sizes)
    order = _order(sizes)
    ids = np.zeros((len(payloads), int(sizes.max(initial=1))), np.uint16)
    lens = sizes[order]
    m = _Lanes(ids)
    n = m.n
    ordered = [payloads[k] for k in order.tolist()]
    words = np.frombuffer(b"".join(ordered) + b"\0" * 16, "<u2").astype(np.int64)
    at = np.concatenate(([0], np.cumsum([len(x) // 2 for x in ordered])))[:-1].astype(np.int64)
    code = (words[at] << 32) | (words[at + 1] << 16) | words[at + 2]
    at = at + 3
    wide = np.full(n, (1 << 48) - 1, np.int64)

    def refill(k: np.ndarray) -> None:
        wide[k] <<= 16
        code[k] = (code[k] << 16) | words[np.minimum(at[k], len(words) - 1)]
        at[k] += 1

    for t in range(ids.shape[1]):
        live = int(np.searchsorted(-lens, -t, "left"))
        if live < m.n:
            m.shrink(live)
            code, wide, at = code[:live].copy(), wide[:live].copy(), at[:live].copy()
        if _rebuilds(t):
            m.rebuild(t)
        m.predict()
        r = wide >> _P
        v = np.minimum(code // r, 32767)
        kind = (v >= m.edges[1:4]).sum(axis=0)
        c, f = _bounds(m, kind)
        code -= r * c
        wide = r * f
        refill(np.flatnonzero(wide < _LOW))
        own = np.where(kind == 0, m.id2, m.id1).astype(np.int64)
        k = np.flatnonzero(kind >= 2)
        if len(k):
            raw = kind[k] == 3
            whole = np.where(raw, 1 << _RAW_BITS, m.total)
            r = wide[k] // whole
            v = np.minimum(code[k] // r, whole - 1)
            c, f, got = v, np.ones(len(k), np.int64), v
            if m.total:
                slot = m.lane[k] * m.total + np.where(raw, 0, v)
                c = np.where(raw, v, m.start[slot])
                f = np.where(raw, 1, m.count[slot])
                got = np.where(raw, v, m.sorted[slot])
            code[k] -= r * c
            wide[k] = r * f
            refill(k[wide[k] < _LOW])
            own[k] = got
        ids[: m.n, t] = own
        m.learn(own, kind)
    out: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(payloads)
    for lane, k in enumerate(order.tolist()):
        out[k] = ids[lane, : sizes[k]]
    return out


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u2").tobytes())
