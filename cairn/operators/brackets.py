"""What surrounds the tokens of a source: brackets, blocks, statements and the tokens beside, as Arrow columns of many files at once.

Braces are matched by running depths and their minima, then parentheses and square brackets the same way within each block. Every
step is an array operation over the tokens of a batch; a file is a range of it. Spark deals the files and derives all facts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What surround() gives for a token. shut, of an opening bracket that has a partner: its pos, end and next token; after, after2: the
#: next token of the partners of the next token and the one behind it. round: how many matched parentheses and square brackets of the
#: block are open; stray: a bracket without a partner. begins, ends: bytes of the statement; words: bits of those in it outside
#: parentheses; final: whether that word is in it. body, arrow, stop: of the next brace, arrow, and comma or semicolon of the statement
#: outside parentheses. run: bits of the words right before a token. made_by: whether `new` stands before the parentheses before a brace.
FIELDS = {
    "pos": "int", "token": "string", "start": "bigint", "end": "bigint", "prev_start": "bigint", "prev_end": "bigint", "next_start": "bigint", "last": "bigint",
    "prev": "string", "prev2": "string", "next": "string", "next2": "string", "next3": "string", "block": "int", "round": "int", "stray": "boolean",
    "shut_pos": "int", "shut_end": "bigint", "shut_next": "string", "after": "string", "after2": "string", "begins": "bigint", "ends": "bigint", "words": "int",
    "final": "boolean", "body_pos": "int", "body_end": "bigint", "arrow_next": "string", "stop_end": "bigint", "made_start": "bigint", "made_by": "boolean",
    "led_from": "bigint", "led_by": "string", "run": "int", "in_package": "boolean", "callee": "string", "callee_start": "bigint", "leads": "string", "leads2": "string",
}

TYPES = {k: {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[v] for k, v in FIELDS.items()}


def before(cond: np.ndarray, first: np.ndarray, back: int = 1) -> np.ndarray:
    """The place of the last row that meets a condition among those at least `back` rows before, from first on; below first if there is none."""
    last = np.maximum.accumulate(np.where(cond, np.arange(len(cond)), -1))
    return np.maximum(np.concatenate([np.full(back, -1), last])[: len(cond)], first - 1)


def behind(cond: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The place of the first row after each that meets a condition, before end; end if there is none."""
    n = len(cond)
    following = np.minimum.accumulate(np.where(cond, np.arange(n), n)[::-1])[::-1]
    return np.minimum(np.append(following, n)[1:], end)


def ranges(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of sorted keys: number, first place and end of its range."""
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    number = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
    return number, starts[number], np.append(starts[1:], len(key))[number]


def depths(step: np.ndarray, number: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of steps within ranges, and the least of them or zero before each row."""
    total = np.cumsum(step)
    depth = total - (total - step)[first]
    # A range lies below all before it, so that one running minimum serves all.
    shift = number * (2 * len(step) + 2)
    least = np.minimum.accumulate(np.minimum(depth, 0) - shift) + shift
    return depth, np.where(np.arange(len(step)) > first, np.append(0, least)[:-1], 0)


def surround(words: dict[str, list[str]], said: dict[str, int], run: dict[str, int], kept_only: bool):
    """An Arrow function of the files' pieces (lists of token, size, total), to lists of FIELDS.

    words: link (parts of a name behind `new`), leading and run (words that may stand before a declaration), and facts: what is
    kept with kept_only besides brackets, names that may declare and tokens beside the ends of statements. said, run: bits of words.
    """
    known = list(dict.fromkeys(["{", "}", "(", ")", "[", "]", ";", ",", "=>", "=", ".", ":", "-", "new", "package", "final", *said, *run, *(w for v in words.values() for w in v)]))
    place = {w: k for k, w in enumerate(known)}

    def table(chosen) -> np.ndarray:
        flags = np.zeros(len(known) + 1, bool)
        flags[[place[w] for w in chosen]] = True
        return flags

    def bits(of: dict[str, int]) -> np.ndarray:
        out = np.zeros(len(known) + 1, np.int64)
        out[[place[w] for w in of]] = list(of.values())
        return out

    flags, said_bits = {k: table(v) for k, v in words.items()}, bits(said)

    def one_batch(pieces: pa.Array) -> pa.Array:
        counts = pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pieces.flatten()
        token, size, total = flat.field("token"), flat.field("size").to_numpy(zero_copy_only=False).astype(np.int64), flat.field("total").to_numpy(zero_copy_only=False).astype(np.int64)
        file = np.repeat(np.arange(len(counts)), counts)
        real = size > 0
        if not real.any():
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(counts) + 1, np.int32)), pa.StructArray.from_arrays([pa.array([], t) for t in TYPES.values()], names=list(TYPES)))
        token, size, total, file = token.filter(pa.array(real)), size[real], total[real], file[real]
        n = len(file)
        number, first, end_of = ranges(file)
        at = np.arange(n)
        code = pc.fill_null(pc.index_in(token, value_set=pa.array(known, token.type)), len(known)).to_numpy(zero_copy_only=False)
        offsets = np.frombuffer(token.buffers()[1], np.int32, count=n + 1, offset=4 * token.offset)[:n]
        head = np.frombuffer(token.buffers()[2], np.uint8)[offsets]
        name = (head >= 97) & (head <= 122) | (head >= 65) & (head <= 90) | (head == 95) | (head == 36)
        is_ = lambda *w: table(w)[code]
        sums = np.cumsum(total)
        end = sums - (sums - total)[first]
        start, prev_end = end - size, end - total
        next_ok, prev_ok = at + 1 < end_of, at > first
        # Braces: a token's block is opened by the last brace a level above.
        opens, shuts = is_("{"), is_("}")
        depth, least = depths(opens.astype(np.int64) - shuts, number, first)
        stray = shuts & (depth < least)
        level = depth - np.minimum(least, depth) - opens
        brace = np.flatnonzero(opens)
        key = np.concatenate([file, file[brace]]) * (n + 2) + np.concatenate([level - 1, level[brace]]) + 1
        where, is_open = np.concatenate([at, brace]), np.concatenate([np.zeros(n, bool), np.ones(len(brace), bool)])
        order = np.lexsort((where, key))
        _, group_first, _ = ranges(key[order])
        found = before(is_open[order], group_first)
        block = np.empty(n + len(brace), np.int64)
        block[order] = np.where(found >= group_first, where[order][found], -1)
        block = block[:n]
        # Within a block the row behind an opening brace is its partner. From here rows are in the order of blocks.
        own = np.where(block < 0, n + file, block)
        s = np.argsort(own, kind="stable")
        number_b, first_b, end_b = ranges(own[s])
        last_b = np.arange(n) + 1 == end_b
        nxt = np.append(s[1:], 0)[:n]
        partner = np.full(n, -1)
        braced = opens[s] & ~last_b & shuts[nxt]
        partner[s[braced]] = nxt[braced]
        opens_r, shuts_r = is_("(", "["), is_(")", "]")
        depth, least = depths(opens_r[s].astype(np.int64) - shuts_r[s], number_b, first_b)
        stray[s] |= shuts_r[s] & (depth < least)
        turn = depth - np.minimum(least, depth) - opens_r[s]
        # Among those of a depth that have partners, an opening one and its partner take turns.
        paired = np.flatnonzero((opens_r | shuts_r)[s] & ~stray[s])
        key = number_b[paired] * (n + 2) + turn[paired]
        order = np.argsort(key, kind="stable")
        rows, key = s[paired[order]], key[order]
        a, b = rows[:-1], rows[1:]
        fits = (key[1:] == key[:-1]) & opens_r[a] & shuts_r[b]
        same = is_("(")[a] & is_(")")[b] | is_("[")[a] & is_("]")[b]
        partner[a[fits & same]] = b[fits & same]
        opener = np.full(n, -1)
        opener[b[fits]] = a[fits]
        stray |= (opens_r | opens) & (partner < 0)
        # From here only matched brackets count, so that what follows an unmatched one is not taken to be within it.
        has = partner >= 0
        step = (opens_r & has).astype(np.int64) - (shuts_r & ~stray)
        depth, _ = depths(step[s], number_b, first_b)
        round_ = np.empty(n, np.int64)
        round_[s] = np.maximum(0, depth - (opens_r & has)[s])
        flat_ = round_ == 0
        ends = (is_("}", ";") & flat_)[s]
        _, first_s, end_s = ranges(number_b * (n + 2) + depths(ends.astype(np.int64), number_b, first_b)[0] - ends)
        begins, closes = np.empty(n, np.int64), np.empty(n, np.int64)
        begins[s], closes[s] = start[s[first_s]], end[s[end_s - 1]]
        runs, back_to = np.unique(first_s, return_inverse=True)

        def of_statement(values: np.ndarray) -> np.ndarray:
            out = np.zeros(n, np.int64)
            out[s] = np.bitwise_or.reduceat(values[s], runs)[back_to]
            return out

        def next_in(cond: np.ndarray) -> np.ndarray:
            found, out = behind((cond & flat_)[s], end_s), np.full(n, -1)
            ok = found < end_s
            out[s[ok]] = s[found[ok]]
            return out

        body, arrow, stop = next_in(opens), next_in(is_("=>")), next_in(is_(",", ";"))
        # `non-sealed` is three tokens.
        ahead = lambda cond, k: np.append(cond[k:], np.zeros(k, bool))[:n] & (at + k < end_of)
        past = lambda cond, k: np.append(np.zeros(k, bool), cond)[:n] & (at - k >= first)
        dashed = is_("non") & ahead(is_("-"), 1) & ahead(is_("sealed"), 2)
        spoken = np.where(is_("non") & ~dashed | past(is_("-"), 1) & past(is_("non"), 2), 0, said_bits[code])
        # What the tokens before tell.
        broken = before(~((name | (head >= 48) & (head <= 57) | flags["link"][code]) & ~flags["keyword"][code]), first)
        made = is_("(") & (broken >= first) & (code[np.maximum(broken, 0)] == place["new"])
        led = before(~flags["leading"][code], first)
        names = before(is_("package", ";", "{", "}"), first)
        plain = ~flags["run"][code]
        since = np.where(is_("="), before(plain, first, 2), before(plain, first))
        run_bits = np.zeros(n, np.int64)
        for w, bit in run.items():
            run_bits |= np.where(before(is_(w), first, 0) > since, bit, 0)
        prev = np.maximum(at - 1, 0)
        made_by = opens & prev_ok & is_(")")[prev] & (opener[prev] >= 0) & made[np.maximum(opener[prev], 0)]
        # A callee is a name with the names and dots before it, four at most.
        called = is_("(") & prev_ok
        linked = name & ~flags["keyword"][code]
        length, going = np.ones(n, np.int64), called
        for k in (2, 4, 6, 8):
            dot, word = np.maximum(at - k, 0), np.maximum(at - k - 1, 0)
            going = going & (at - k - 1 >= first) & is_(".")[dot] & linked[word]
            length += 2 * going
        in_package = (names >= first) & is_("package")[np.maximum(names, 0)]
        kept = np.ones(n, bool)
        if kept_only:
            after = np.append(code[1:], len(known))[:n]
            after = np.where(next_ok, after, len(known))
            near = lambda *w: table(w)[after]
            edge = ~prev_ok | ~next_ok | is_("{", "}", ";")[prev] | near("}")
            dangling = is_(".", ":", "=", "=>") & near(")", "]", "}", ";", ",")
            kept = opens | shuts | opens_r | shuts_r | flags["facts"][code] | name & near("(", "=", ";", ",", ":") | dangling | edge | in_package
        rows = np.flatnonzero(kept)

        def text(k: np.ndarray, ok: np.ndarray, other: str | None = None) -> pa.Array:
            found = token.take(pa.array(np.where(ok, k, 0)[rows], mask=~ok[rows]))
            return found if other is None else pc.fill_null(found, other)

        value = lambda a, k=at, ok=np.ones(n, bool): pa.array(a[np.where(ok, k, 0)[rows]], mask=~ok[rows])
        callee = pc.binary_join_element_wise(*[text(at - k, called & (length >= k), "") for k in range(9, 0, -1)], "")

        def shut_next(k: int) -> pa.Array:
            opening = np.minimum(at + k, n - 1)
            ok, behind_it = (at + k < end_of) & has[opening], partner[opening] + 1
            return pc.if_else(pa.array(ok[rows]), text(behind_it, ok & (behind_it < end_of), ""), pa.scalar(None, token.type))
        pos, beside = at - first, lambda k: text(at + k, (at + k >= first) & (at + k < end_of), "")
        out = {
            "pos": value(pos), "token": token.take(pa.array(rows)), "start": value(start), "end": value(end), "prev_start": value(start, at - 1, prev_ok), "prev_end": value(prev_end), "next_start": value(start, at + 1, next_ok), "last": value(end, end_of - 1),
            "prev": beside(-1), "prev2": beside(-2), "next": beside(1), "next2": beside(2), "next3": beside(3), "block": value(np.where(block < 0, -1, block - first)), "round": value(round_), "stray": value(stray),
            "shut_pos": value(pos, partner, has), "shut_end": value(end, partner, has), "shut_next": shut_next(0), "after": shut_next(1), "after2": shut_next(2), "begins": value(begins), "ends": value(closes), "words": value(of_statement(np.where(flat_, spoken, 0))),
            "final": value(of_statement(is_("final").astype(np.int64)) > 0), "body_pos": value(pos, body, body >= 0), "body_end": value(end, partner[body], (body >= 0) & has[body]), "arrow_next": text(arrow + 1, (arrow >= 0) & (arrow + 1 < end_of)),
            "stop_end": value(prev_end, stop, stop >= 0), "made_start": value(start, broken, made), "made_by": value(made_by), "led_from": value(start, led + 1), "led_by": text(led, led >= first, ";"), "run": value(run_bits), "in_package": value(in_package),
            "callee": callee, "callee_start": value(start, at - length, called), "leads": text(at - length - 1, called & (at - length - 1 >= first), ""), "leads2": text(at - length - 2, called & (at - length - 2 >= first), ""),
        }
        columns = [out[k].cast(t) for k, t in TYPES.items()]
        per_file = np.bincount(file[rows], minlength=len(counts))
        lists = pa.array(np.append(0, np.cumsum(per_file)).astype(np.int32))
        return pa.ListArray.from_arrays(lists, pa.StructArray.from_arrays(columns, names=list(FIELDS)))

    return one_batch


def surrounded(pieces: str, **settings) -> Column:
    """The array of FIELDS of a column of pieces."""
    one_batch = surround(**settings)

    @F.arrow_udf("array<struct<" + ",".join(f"`{k}`:{v}" for k, v in FIELDS.items()) + ">>")
    def place(column: pa.Array) -> pa.Array:
        return one_batch(column)

    return place(pieces)
