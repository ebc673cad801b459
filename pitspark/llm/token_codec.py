"""Context-mixing range coder for token ids, in numpy.

Blocks are independent: each starts with a fresh model and carries its alphabet (the
distinct ids it holds). All blocks of a batch are coded in step, one id of every block
at a time, so each step is a few dozen vector operations over the blocks.

Model of a block. Order 2 and order 1 each predict one id, the one that followed the
last two ids, or the last id, before, with a confidence of 0 to 3. In each of the 32
states (both confidences, and whether the predictions agree) the frequencies in the block weigh
the three outcomes: as order 2 says, as order 1 says, or neither. In the last case order
0, the frequencies of such ids in the block, which the alphabet carries, gives the id. It depends on
no other id, so these ids have a stream of their own, which is read first. The weights of the states come
between the streams. As the predictions follow from the ids alone, only they are made in step when blocks are
coded; states, outcomes and their spans come from whole arrays.

Both streams are range coded (rANS) with frequencies that add up to ``SCALE``, so that decoding divides
nothing. All numbers are integers, so that coder and decoder agree everywhere.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

BLOCK = 4096
HASH = 4096
STATES = 32
_BITS = 12
SCALE = 1 << _BITS  # as large as a block, so that counts of a block's ids are scaled up, none to zero
_LOW = 1 << 16  # states of the coder are at least this, and below 2^32
_CODES = 128  # a state's three outcomes are 4 state + 0, 1, 2; 4 state + 3 is none
_STRIP = 64  # steps whose states are found together
# arrays without dimensions: numpy takes them in half the time of plain integers
SURE, _SURER, _SUREST = (np.array(k << 12, np.int16) for k in (1, 2, 3))  # ids of an alphabet are below the first
_IDS, _ID_BITS, _TWO, _HASHED, _MIX2, _MIX1 = (np.array(k, np.int16) for k in ((1 << 12) - 1, 12, 2, HASH - 1, 1597, 31))
_AGREE_BITS = np.array(4, np.int8)
_SPAN_BITS, _STARTS, _SCALE, _WORD, _WORD_BITS, _HEAD_BITS, _LEAST = (
    np.array(k, np.uint32) for k in (_BITS, SCALE - 1, SCALE, 0xFFFF, 16, 32 - _BITS, _LOW)
)


@dataclass(frozen=True)
class Coded:
    """A coded block: number of ids, its alphabet, the code words, a checksum of the ids."""

    n_ids: int
    alphabet: bytes
    payload: bytes
    crc32: int


def ids_crc32(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


class _Predictions:
    """The predictions of every block of a batch; ``width`` is the size of the largest alphabet.

    A prediction is an integer, the id plus ``SURE`` times the confidence, so that confidence 0 means none. Those of
    order 1 are row 0, those of order 2 row 1.
    """

    def __init__(self, lanes: int, width: int):
        lane = np.arange(lanes, dtype=np.int64)
        self.base = np.stack([lane * width, lanes * width + lane * HASH])
        self.follows = np.zeros(lanes * (width + HASH), np.int16)

    def learn(self, at: np.ndarray, v: np.ndarray, says: np.ndarray, x: np.ndarray) -> None:
        """Updates the predictions ``v`` of the ids ``says``, which are at ``at``, with the ids ``x`` that came."""
        missed = np.where(v >= _SURER, v - SURE, x + SURE)
        # one dimension and the table's own type: numpy has no fast path for other assignments
        self.follows[at.ravel()] = np.where(says == x, np.minimum(v + SURE, v | _SUREST), missed).ravel()


def _contexts(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Places of the last two ids under order 2; products modulo 2^16, a multiple of HASH."""
    return (before * _MIX2 + last * _MIX1) & _HASHED


def _steps(lengths: np.ndarray) -> np.ndarray:
    """Number of blocks still running at each step; ``lengths`` must not increase."""
    return np.searchsorted(-lengths, -np.arange(int(lengths.max(initial=0))), side="left")


def _write_spans(spans: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """Code words of spans (see ``_joined``), a column for each block; ``lengths`` must not increase."""
    steps, lanes = spans.shape
    state = np.full(lanes, _LOW, np.uint32)
    words = np.empty(lanes * (steps + 1), "<u2")
    ends = np.arange(1, lanes + 1, dtype=np.int64) * (steps + 1)
    at = ends - 1
    for t, n in reversed(list(enumerate(_steps(lengths)))):
        x, span, here = state[:n], spans[t, :n], at[:n]
        f = span >> _SPAN_BITS
        words[here] = x.astype("<u2")  # low bits, kept where the state is too large
        large = (x >> _HEAD_BITS) >= f
        x = np.where(large, x >> _WORD_BITS, x)
        here -= large
        state[:n] = x + x // f * (_SCALE - f) + (span & _STARTS)
    heads = state.astype("<u4")
    return [heads[k:k + 1].tobytes() + words[at[k] + 1:ends[k]].tobytes() for k in range(lanes)]


class _Reader:
    """Streams of code words read in step."""

    def __init__(self, streams: list[np.ndarray]):
        sizes = np.array([len(s) for s in streams], np.int64)
        self.words = np.concatenate([*streams, np.zeros(2, "<u2")])
        first = np.cumsum(sizes) - sizes
        self.state = self.words.take(first).astype(np.uint32) | (self.words.take(first + 1).astype(np.uint32) << 16)
        self.at = first + 2

    def keep(self, n: int) -> None:
        """Goes on with the first ``n`` streams."""
        self.state, self.at = self.state[:n], self.at[:n]

    def advance(self, slot: np.ndarray, start: np.ndarray, freq: np.ndarray) -> None:
        x = (self.state >> _SPAN_BITS) * freq + (slot - start)
        small = x < _LEAST
        more = (x << _WORD_BITS) | self.words.take(self.at, mode="clip").astype(np.uint32)
        self.state = np.where(small, more, x)
        self.at += small


def _joined(start: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """Spans, the start in the low bits and the frequency above."""
    return (start | (freq << _BITS)).astype(np.uint32)


def _scaled(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans and frequencies of ids, of ``SCALE`` together; a row of counts for each block."""
    upto = counts.cumsum(1, dtype=np.int32)
    ends = upto * np.int32(SCALE) // np.maximum(upto[:, -1:], 1)
    freq = np.diff(ends, axis=1, prepend=np.int32(0))
    return _joined(ends - freq, freq), freq


def _pack_alphabet(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Distinct ids, as gaps, and their counts under order 0, low bytes and high bytes apart."""
    both = np.concatenate([np.diff(ids, prepend=0), counts])
    deflate = zlib.compressobj(1, strategy=zlib.Z_RLE)
    return deflate.compress((both & 255).astype(np.uint8).tobytes() + (both >> 8).astype(np.uint8).tobytes()) + deflate.flush()


def _unpack_alphabet(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.frombuffer(zlib.decompress(packed), np.uint8).astype(np.int64).reshape(2, -1)
    gaps, counts = (low | (high << 8)).reshape(2, -1)
    return gaps.cumsum(), counts


def _rounded(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes, rounded down to five binary digits, so that those of a block are at most ``SCALE`` together."""
    power = np.maximum(np.frexp(counts)[1] - 5, 0)
    return (power * 16 + (counts >> power)).astype(np.uint8)


def _counts(rounded: np.ndarray) -> np.ndarray:
    power = np.maximum((rounded.astype(np.int64) >> 4) - 1, 0)
    return (rounded - power * 16) << power


def _pack_weights(rounded: np.ndarray) -> bytes:
    """A block's weights: which are not 0, and these, up to a whole word."""
    some = rounded > 0
    packed = np.packbits(some).tobytes() + rounded[some].tobytes()
    return packed + bytes(len(packed) % 2)


def _unpack_weights(words: np.ndarray) -> tuple[np.ndarray, int]:
    """The weights, and how many words they take."""
    raw = words.view(np.uint8)
    some = np.unpackbits(raw[:_CODES // 8]).astype(bool)
    upto = _CODES // 8 + int(some.sum())
    rounded = np.zeros(_CODES, np.uint8)
    rounded[some] = raw[_CODES // 8:upto]
    return rounded, (upto + 1) // 2


def _outcome_spans(rounded: np.ndarray) -> np.ndarray:
    """Spans of the three outcomes of each state; after them, where the first two end, in 16 bits each."""
    counts = _counts(rounded).reshape(-1, STATES, 4)[:, :, :3]
    upto = counts.cumsum(2)
    ends = upto * SCALE // np.maximum(upto[:, :, 2:], 1)
    freq = np.diff(ends, axis=2, prepend=0)
    both = ends[:, :, 0] | (ends[:, :, 1] << 16)
    return np.concatenate([_joined(ends - freq, freq), both[:, :, None].astype(np.uint32)], axis=2).ravel()


def _codes(data: np.ndarray, steps: np.ndarray, width: int) -> np.ndarray:
    """State and outcome of each id, a row for each step; code 3 beyond a block's end."""
    longest, lanes = data.shape
    codes = np.full((longest, lanes), 3, np.uint8)
    model = _Predictions(lanes, width)
    before = np.concatenate([np.zeros((2, lanes), np.int16), data])
    for t0 in range(0, longest, _STRIP):
        t1, n = min(t0 + _STRIP, longest), steps[t0]
        last = before[t0 + 1:t1 + 1, :n]
        at = np.stack([last, _contexts(before[t0:t1, :n], last)], axis=1) + model.base[:, :n]
        held = np.zeros(at.shape, np.int16)
        for t in range(t0, t1):
            here = steps[t]
            place = at[t - t0, :, :here]
            v = model.follows.take(place, mode="clip")
            held[t - t0, :, :here] = v
            model.learn(place, v, v & _IDS, data[t, :here])
        says, sure = held & _IDS, (held >> _ID_BITS).astype(np.uint8)
        differs = says != data[t0:t1, None, :n]
        state = sure[:, 0] + (sure[:, 1] << 2) + ((says[:, 0] == says[:, 1]).view(np.uint8) << 4)
        neither = differs.all(1)
        found = (state << 2) + differs[:, 1] + neither
        found[np.arange(n) >= steps[t0:t1, None]] = 3
        codes[t0:t1, :n] = found
    return codes


def encode_blocks(blocks: list[np.ndarray]) -> list[Coded]:
    """Codes blocks of at most ``BLOCK`` ids below 65536 each."""
    if not blocks:
        return []
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    lengths = np.array([len(blocks[i]) for i in order], np.int64)
    lanes, longest = len(blocks), int(lengths.max())
    if longest > BLOCK:
        raise ValueError("block too long")
    alphabets = []
    columns = np.zeros((lanes, longest + _STRIP), np.int16)  # rows apart by no power of 2, which caches take badly
    place, seen = np.zeros(1 << 16, np.int16), np.zeros(1 << 16, bool)
    for k, i in enumerate(order):
        seen[blocks[i]] = True
        eights = np.flatnonzero(seen.view(np.uint64))  # eight at once, as most are not seen
        alphabet = np.flatnonzero(seen.reshape(-1, 8)[eights])
        alphabet = (eights.take(alphabet >> 3) << 3) + (alphabet & 7)
        seen[alphabet] = False
        place[alphabet] = np.arange(len(alphabet), dtype=np.int16)
        alphabets.append(alphabet)
        columns[k, :lengths[k]] = place.take(blocks[i])
    sizes = np.array([len(a) for a in alphabets], np.int64)
    data = np.ascontiguousarray(columns[:, :longest].T)
    codes = _codes(data, _steps(lengths), max(1, int(sizes.max())))
    lane = np.arange(lanes, dtype=np.int64) * _CODES
    weights = np.zeros(lanes * _CODES, np.int64)
    for t in range(0, longest, _STRIP):
        weights += np.bincount((codes[t:t + _STRIP] + lane).ravel(), minlength=lanes * _CODES)
    weights = weights.reshape(lanes, _CODES)
    weights[:, 3::4] = 0
    rounded = _rounded(weights)
    table = _outcome_spans(rounded)
    spans = np.empty((longest, lanes), np.uint32)
    for t in range(0, longest, _STRIP):
        spans[t:t + _STRIP] = table.take(codes[t:t + _STRIP] + lane)
    outcomes = _write_spans(spans, lengths)
    # ids under order 0, strip by strip of the blocks, most such ids first
    n0 = weights[:, 2::4].sum(1)
    width = max(1, int(sizes.max()))
    counts = np.zeros((lanes, width), np.int32)
    spans = np.zeros((int(n0.max()), lanes), np.uint32)
    falling = np.argsort(-n0, kind="stable")
    for k in range(0, lanes, _STRIP):
        own = falling[k:k + _STRIP]
        ids = columns[own, :longest][np.ascontiguousarray((codes[:, own] & 3 == 2).T)]
        entries = np.repeat(np.arange(len(own)) * width, n0[own]) + ids
        counts[own] = np.bincount(entries, minlength=len(own) * width).reshape(-1, width)
        rows = np.zeros((len(own), len(spans)), np.uint32)
        rows[np.arange(len(spans)) < n0[own, None]] = _scaled(counts[own])[0].ravel().take(entries)
        spans[:, k:k + _STRIP] = rows.T
    plain: list[bytes] = [b""] * lanes
    for k, own in zip(falling, _write_spans(spans, n0[falling])):
        plain[k] = own
    result: list[Coded] = [None] * len(blocks)
    for k, i in enumerate(order):
        head = np.array([len(plain[k]) // 2], "<u2").tobytes()
        packed = _pack_alphabet(alphabets[k], counts[k, :sizes[k]])
        result[i] = Coded(
            len(blocks[i]), packed, head + plain[k] + _pack_weights(rounded[k]) + outcomes[k], ids_crc32(blocks[i]),
        )
    return result


def _read_order0(streams: list[np.ndarray], counts: np.ndarray) -> np.ndarray:
    """The ids under order 0, a row for each block."""
    n0 = counts.sum(1)
    falling = np.argsort(-n0, kind="stable")
    falling = falling[n0[falling] > 0]
    rows = np.zeros((len(streams), int(n0.max(initial=0)) + 1), np.int16)
    if not len(falling):
        return rows
    spans, freq = _scaled(counts[falling])
    lanes, width = spans.shape
    table = np.repeat(np.tile(np.arange(width, dtype=np.int16), lanes), freq.ravel())
    spans = spans.ravel()
    lane = np.arange(lanes, dtype=np.int64)
    at_table, at_span = lane * SCALE, lane * width
    reader = _Reader([streams[k] for k in falling])
    found = np.zeros((rows.shape[1], lanes), np.int16)
    for t, n in enumerate(_steps(n0[falling])):
        reader.keep(n)
        slot = reader.state & _STARTS
        x = table.take(at_table[:n] + slot, mode="clip")
        span = spans.take(at_span[:n] + x, mode="clip")
        reader.advance(slot, span & _STARTS, span >> _SPAN_BITS)
        found[t, :n] = x
    rows[falling] = found.T
    return rows


def decode_blocks(coded: list[Coded]) -> list[np.ndarray]:
    """The ids of every block; raises where a checksum does not hold."""
    if not coded:
        return []
    order = sorted(range(len(coded)), key=lambda i: -coded[i].n_ids)
    lengths = np.array([coded[i].n_ids for i in order], np.int64)
    lanes, longest = len(coded), int(lengths.max())
    alphabets, listed = zip(*(_unpack_alphabet(coded[i].alphabet) for i in order))
    sizes = np.array([len(a) for a in alphabets], np.int64)
    counts = np.zeros((lanes, max(1, int(sizes.max()))), np.int32)
    for k, c in enumerate(listed):
        counts[k, :len(c)] = c
    if (counts.sum(1) > lengths).any():
        raise ValueError("token block with more ids under order 0 than it has")
    words = [np.frombuffer(coded[i].payload, "<u2") for i in order]
    order0 = _read_order0([w[1:1 + w[0]] for w in words], counts)
    flat0, at0 = order0.ravel(), np.arange(lanes, dtype=np.int64) * order0.shape[1]
    rest = [w[1 + int(w[0]):] for w in words]
    rounded, taken = zip(*map(_unpack_weights, rest))
    table = _outcome_spans(np.array(rounded))
    ends = table[3:]
    reader = _Reader([w[k:] for w, k in zip(rest, taken)])
    model = _Predictions(lanes, max(1, int(sizes.max())))
    base, base_s = model.base, np.arange(lanes, dtype=np.int64) * _CODES
    data = np.zeros((longest, lanes), np.int16)
    at, last = base.copy(), np.zeros(lanes, np.int16)
    for t, n in enumerate(_steps(lengths)):
        if n < len(last):
            reader.keep(n)
            at, at0, base, base_s, last = at[:, :n], at0[:n], base[:, :n], base_s[:n], last[:n]
        v = model.follows.take(at, mode="clip")
        says, sure = v & _IDS, v >> _ID_BITS
        agree = (says[0] == says[1]).view(np.int8) << _AGREE_BITS
        at_s = base_s + ((sure[0] + (sure[1] << _TWO) + agree) << _TWO)
        both = ends.take(at_s, mode="clip")
        slot = reader.state & _STARTS
        not2, neither = slot >= (both & _WORD), slot >= (both >> _WORD_BITS)
        span = table.take(at_s + (not2.view(np.int8) + neither.view(np.int8)), mode="clip")
        reader.advance(slot, span & _STARTS, span >> _SPAN_BITS)
        x = np.where(neither, flat0.take(at0, mode="clip"), np.where(not2, says[0], says[1]))
        at0 += neither
        model.learn(at, v, says, x)
        data[t, :n] = x
        np.add(base[0], x, out=at[0])
        np.add(base[1], _contexts(last, x), out=at[1])
        last = x
    columns = data.T
    result: list[np.ndarray] = [None] * lanes
    for k, i in enumerate(order):
        ids = alphabets[k].take(columns[k, :lengths[k]], mode="clip") if lengths[k] else np.empty(0, np.int64)
        if ids_crc32(ids) != coded[i].crc32:
            raise ValueError("token block does not match its checksum")
        result[i] = ids
    return result


# --- combining checksums ----------------------------------------------------

def _times(matrix: list[int], vector: int) -> int:
    total = 0
    for row in matrix:
        if not vector:
            break
        if vector & 1:
            total ^= row
        vector >>= 1
    return total


def _zero_operators() -> list[list[int]]:
    """Linear maps that append 2^k zero bytes to a CRC-32 register."""
    bit = [0xEDB88320] + [1 << k for k in range(31)]
    maps = [bit]
    for _ in range(3 + 48):
        last = maps[-1]
        maps.append([_times(last, row) for row in last])
    return maps[3:]


_ZEROS = _zero_operators()


def join_crc32(first: int, second: int, second_bytes: int) -> int:
    """CRC-32 of two byte strings in a row, from the CRC-32 of each."""
    k = 0
    while second_bytes:
        if second_bytes & 1:
            first = _times(_ZEROS[k], first)
        second_bytes >>= 1
        k += 1
    return first ^ second
