"""The split of text before byte-pair merges, as a finite-state transducer run in parallel.

The pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` needs no
more than two characters of look-back once its matches are read as cuts, so eleven states do. A step's
characters are dealt to chunks; each chunk's map from entry state to exit state is computed for all
chunks in lockstep, the maps are composed by a parallel prefix scan, and a second lockstep run from
the entry states so found writes the cuts. A document's first character is a symbol of its own that
leads to the start state, so one run serves many documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np

#: Symbols: letter, number, other, space, other white space, apostrophe, and the letters of contractions.
LETTER, NUMBER, OTHER, SPACE, BLANK, QUOTE, STMD, R, V, LL, EE, PAD = range(12)
SYMBOLS = 12
#: States: between tokens; in letters, numbers, others; one space; a blank run that ends in a space; one other
#: blank; a longer run that ends in such; after an apostrophe that begins a token; after 'r, 'v, 'l.
NONE, LETTERS, NUMBERS, OTHERS, SP1, SP2, BL1, BL2, Q, QR, QV, QL = range(12)
STATES = 12
#: Outputs: a token begins at this character; at the one before it.
HERE, BEFORE = 1, 2
CHUNK = 128
#: Steps after which chunks whose map has become constant follow one state only.
SETTLE = 12


def _tables() -> tuple[np.ndarray, np.ndarray]:
    to, out = np.zeros((STATES, 2 * SYMBOLS), np.uint8), np.zeros((STATES, 2 * SYMBOLS), np.uint8)
    letters = (LETTER, STMD, R, V, LL, EE)
    opened = {**dict.fromkeys(letters, LETTERS), NUMBER: NUMBERS, OTHER: OTHERS, QUOTE: Q, SPACE: SP1, BLANK: BL1}
    joined = opened | {QUOTE: OTHERS}
    for state in range(STATES):
        for symbol, fresh in opened.items():
            # Unless said otherwise below, the character begins a token.
            to[state, symbol], out[state, symbol] = fresh, HERE
            if state in (SP2, BL2) and symbol not in (SPACE, BLANK):
                # The last blank of a run leaves it: a space joins what follows, another blank stands alone.
                to[state, symbol], out[state, symbol] = (joined[symbol], BEFORE) if state == SP2 else (fresh, BEFORE | HERE)
            if state == SP1 and symbol not in (SPACE, BLANK):
                to[state, symbol], out[state, symbol] = joined[symbol], 0
            if state in (SP1, SP2, BL1, BL2) and symbol in (SPACE, BLANK):
                to[state, symbol], out[state, symbol] = (SP2 if symbol == SPACE else BL2), 0
            if state in (QR, QV, QL):
                # No contraction after all: the apostrophe was a token, the letter begins the next.
                out[state, symbol] = BEFORE if symbol in letters else BEFORE | HERE
    for symbol in letters:
        to[LETTERS, symbol], out[LETTERS, symbol] = LETTERS, 0
    to[NUMBERS, NUMBER], out[NUMBERS, NUMBER] = NUMBERS, 0
    for state in (OTHERS, Q):
        for symbol in (OTHER, QUOTE):
            to[state, symbol], out[state, symbol] = OTHERS, 0
    for state, symbol, then in ((Q, STMD, NONE), (Q, R, QR), (Q, V, QV), (Q, LL, QL), (QR, EE, NONE), (QV, EE, NONE), (QL, LL, NONE)):
        to[state, symbol], out[state, symbol] = then, 0
    to[:, PAD] = np.arange(STATES)
    # Symbols from SYMBOLS on are first characters of documents.
    to[:, SYMBOLS:] = to[NONE, :SYMBOLS]
    out[:, SYMBOLS:] = HERE
    out[[QR, QV, QL], SYMBOLS:] |= BEFORE
    return to.ravel(), out.ravel()


_TO, _OUT = _tables()


def classes_from(found: Callable[[str, str], list[int]]) -> bytes:
    """The compressed symbol table of all code points. ``found(class, text)``: places in text of that class's characters."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text, at = "".join(map(chr, points)), np.array(points)
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, symbol in ((r"\s", BLANK), (r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
        table[at[found(pattern, text)]] = symbol
    for characters, symbol in ((" ", SPACE), ("'", QUOTE), ("stmd", STMD), ("r", R), ("v", V), ("l", LL), ("e", EE)):
        for c in characters:
            table[ord(c)] = symbol
    return zlib.compress(table.tobytes())


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 and the byte each begins at."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    point = data[at].astype(np.int32)
    multi = np.flatnonzero(point >= 0xC0)
    if len(multi):
        place, lead = at[multi], point[multi]
        padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
        b1, b2, b3 = (padded[place + k] & 0x3F for k in (1, 2, 3))
        two, three = (lead & 0x1F) << 6 | b1, (lead & 0x0F) << 12 | b1 << 6 | b2
        point[multi] = np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, (lead & 0x07) << 18 | b1 << 12 | b2 << 6 | b3))
    return point, at


def _scan(maps: np.ndarray) -> np.ndarray:
    """Entry state of each chunk when the first is entered in state NONE: inclusive prefix composition by doubling."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        # (earlier then later)[s] = later[earlier[s]]
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
        step *= 2
    return np.concatenate([np.full(1, NONE, np.uint8), maps[:-1, NONE]])


def pretokens(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the pretokens of all texts, and the number of them before each text (one more than texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    point, at = code_points(data)
    symbols = table[point].astype(np.uint8)
    first = offsets[:-1][np.diff(offsets) > 0]
    symbols[np.searchsorted(at, first)] += SYMBOLS
    chunks = -(-len(symbols) // CHUNK)
    grid = np.full(chunks * CHUNK, PAD, np.uint8)
    grid[: len(symbols)] = symbols
    grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T).astype(np.uint16)
    # Chunk maps: all states at first, then one state for the chunks whose map has become constant.
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (chunks, 1))
    for k in range(SETTLE):
        maps = _TO[maps * np.uint16(2 * SYMBOLS) + grid[k][:, None]]
    settled = (maps == maps[:, :1]).all(axis=1)
    rest, one = np.flatnonzero(~settled), maps[:, 0]
    some = maps[rest]
    for k in range(SETTLE, CHUNK):
        one = _TO[one * np.uint16(2 * SYMBOLS) + grid[k]]
        if len(rest):
            some = _TO[some * np.uint16(2 * SYMBOLS) + grid[k][rest][:, None]]
    maps = np.repeat(one[:, None], STATES, axis=1)
    maps[rest] = some
    state = _scan(maps)
    cuts = np.empty((CHUNK, chunks), np.uint8)
    for k in range(CHUNK):
        index = state * np.uint16(2 * SYMBOLS) + grid[k]
        cuts[k], state = _OUT[index], _TO[index]
    cuts = np.ascontiguousarray(cuts.T).ravel()[: len(symbols)]
    begins = cuts & HERE > 0
    begins[:-1] |= cuts[1:] & BEFORE > 0
    if state[-1] in (QR, QV, QL):
        begins[-1] = True
    starts = at[begins]
    return starts, np.searchsorted(starts, offsets)
