"""Secret scan: all rules in one deterministic automaton over bytes.

The rules are small regular expressions over bytes. They are compiled to one
nondeterministic automaton, made deterministic by subset construction and minimised by
partition refinement. The result is an array of transitions and an array that says which
rules a state accepts. Many stretches of text are advanced in lockstep, one byte of each
at a time, so that a step is one array lookup for all of them; long stretches are cut into parts.

A stretch ends at a byte that sends every state back to the start; no match can contain
such a byte. A stretch in which a rule is accepted is looked at again with the exact
patterns, which gives the leftmost, non-overlapping spans. A private key goes on over many
lines: the automaton finds its first line, the exact pattern then runs on the whole text.
"""

import functools
import re
from collections import namedtuple

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chatloom.llm.columns import slices, utf8

#: Text bytes that are scanned in lockstep.
BLOCK_BYTES = 4 << 20
#: Bytes from which a stretch is scanned in parts, bytes of a part, and parts at a time.
LONG, PART, PARTS = 4096, 512, 8192

#: ``pattern``: what the automaton looks for, the start of what ``exact`` matches up to where
#: counting characters would only multiply states. ``exact``: spans within a stretch; ``group``
#: must have ``least`` characters. ``whole``: spans are looked for in the whole text, as they go
#: on over the ends of stretches. Kinds are listed in output order.
Rule = namedtuple("Rule", "kind pattern exact group least whole", defaults=[False])

_WORDS = "(password|passwd|secret|token|api_?key)"
_ASSIGN = r"""["']?\x20*[:=]\x20*["']?"""


def _caseless(words):
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_KEY_BEGIN = "-----BEGIN [A-Z ]*PRIVATE KEY-----"
#: From BEGIN to the END line, whatever stands between, but not over another BEGIN or END.
_KEY_TO_END = "[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END [A-Z ]*PRIVATE KEY-----"
#: Without an END line: header fields and lines of base64, also with line ends as escapes; a last
#: line may be short, if it is padded, alone on its line, or at the end of the text.
_KEY_GAP = r"""(?:[\s>"',#*|]|\\[rn])++"""
_KEY_LINES = (rf"(?:{_KEY_GAP}[A-Z][A-Za-z]*-[A-Z][A-Za-z]*:[^\r\n\\]*+)*+(?:{_KEY_GAP}[A-Za-z0-9+/]{{16,}}+={{0,2}}+)++"
              rf"(?:{_KEY_GAP}(?:[A-Za-z0-9+/]{{1,15}}={{1,2}}|(?:[A-Za-z0-9+/]{{4}}){{1,3}}(?=\s*?(?:\n|\\[rn]|\Z))|[A-Za-z0-9+/]{{1,15}}\Z))?"
              rf"|{_KEY_GAP}[A-Za-z0-9+/]{{1,15}}\Z")

RULES = (
    Rule("assign", _caseless(_WORDS) + _ASSIGN + "[A-Za-z0-9+/_.=-]",
         _caseless(_WORDS) + _ASSIGN + "([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", "AKIA[A-Z0-9]", "AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", "[0-9a-f]{16}", "[0-9a-f]+", 0, 16),
    # Further kinds of the method. Their shapes are public formats of keys.
    Rule("key_block", _KEY_BEGIN, f"{_KEY_BEGIN}(?:{_KEY_TO_END}|{_KEY_LINES})?", 0, 1, True),
    Rule("web_token", "eyJ[A-Za-z0-9_-]", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    Rule("forge_token", "gh[oprsu]_[A-Za-z0-9]", "gh[oprsu]_[A-Za-z0-9]{30,}", 0, 1),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9-]", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    Rule("url_login", r"://[A-Za-z0-9._-]+:[A-Za-z0-9._-]+@", r"://[A-Za-z0-9._-]+:[A-Za-z0-9._-]+@", 0, 1),
)
BASE = ("assign", "access", "hex")


# ---- from rules to arrays

class _Nfa:
    """States with byte edges and empty edges, built from a rule's syntax."""

    def __init__(self):
        self.bytes, self.empty = [], []

    def state(self):
        self.bytes.append([])
        self.empty.append([])
        return len(self.empty) - 1

    def add(self, pattern, start):
        """Append a pattern after ``start``; the end state."""
        end, rest = self._choice(pattern, 0, start)
        if rest != len(pattern):
            raise ValueError(f"cannot read {pattern[rest:]!r} in {pattern!r}")
        return end

    def _choice(self, p, i, start):
        end = self.state()
        while True:
            branch = self.state()
            self.empty[start].append(branch)
            last, i = self._sequence(p, i, branch)
            self.empty[last].append(end)
            if i >= len(p) or p[i] != "|":
                return end, i
            i += 1

    def _sequence(self, p, i, start):
        while i < len(p) and p[i] not in "|)":
            atom_at = i
            _, after = self._atom(p, i, self.state())
            low, high, i = _repeats(p, after)
            for _ in range(low):
                start, _ = self._atom(p, atom_at, start)
            if high is None:
                loop = self.state()
                self.empty[start].append(loop)
                back, _ = self._atom(p, atom_at, loop)
                self.empty[back].append(loop)
                start = loop
            else:
                ends = [start]
                for _ in range(high - low):
                    start, _ = self._atom(p, atom_at, start)
                    ends.append(start)
                for e in ends[:-1]:
                    self.empty[e].append(start)
        return start, i

    def _atom(self, p, i, start):
        if p[i] == "(":
            end, i = self._choice(p, i + 1, start)
            return end, i + 1
        chosen, i = _bytes(p, i)
        end = self.state()
        self.bytes[start].append((chosen, end))
        return end, i

    def closure(self, states):
        found, todo = set(states), list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)


def _repeats(p, i):
    """How often an atom may come (low, high or None for no bound) and where to read on."""
    if i < len(p) and p[i] in "?*+":
        return {"?": (0, 1, i + 1), "*": (0, None, i + 1), "+": (1, None, i + 1)}[p[i]]
    if counted := re.compile(r"\{(\d+)(,?)(\d*)\}").match(p, i):
        low, comma, high = counted.groups()
        return int(low), int(high) if high else None if comma else int(low), counted.end()
    return 1, 1, i


def _bytes(p, i):
    """The bytes that one character or class stands for."""
    if p[i] != "[":
        one, i = _literal(p, i)
        return {one}, i
    chosen, i = set(), i + 1
    while p[i] != "]":
        low, i = _literal(p, i)
        if p[i] == "-" and p[i + 1] != "]":
            high, i = _literal(p, i + 1)
            chosen.update(range(low, high + 1))
        else:
            chosen.add(low)
    return chosen, i + 1


def _literal(p, i):
    if p.startswith("\\x", i):
        return int(p[i + 2:i + 4], 16), i + 4
    if p[i] == "\\":
        return ord(p[i + 1]), i + 2
    return ord(p[i]), i + 1


Automaton = namedtuple("Automaton", "step accepts start resets")


@functools.lru_cache(maxsize=4)
def compile_rules(rules=RULES):
    """The minimal automaton that, anywhere in a text, says which rules end at a byte.

    ``step[state * 256 + byte]`` is the next state times 256; ``accepts[state]`` has a bit
    per rule; ``resets[byte]``: the byte leads every state to the start.
    """
    nfa = _Nfa()
    root, ends = nfa.state(), {}
    for bit, rule in enumerate(rules):
        first = nfa.state()
        nfa.empty[root].append(first)
        ends[nfa.add(rule.pattern, first)] = 1 << bit

    # Bytes that no edge tells apart share a class.
    edges = [(s, frozenset(chosen), end) for s, own in enumerate(nfa.bytes) for chosen, end in own]
    marks = np.zeros((256, len(edges)), bool)
    for e, (_, chosen, _) in enumerate(edges):
        marks[list(chosen), e] = True
    _, example, class_of = np.unique(marks, axis=0, return_index=True, return_inverse=True)
    by_state = [[] for _ in nfa.bytes]
    for e, (s, _, end) in enumerate(edges):
        by_state[s].append((np.flatnonzero(marks[example, e]).tolist(), nfa.closure([end])))

    # Subset construction; the root stays in every set, for a match may begin anywhere.
    first = nfa.closure([root])
    number, order, rows = {first: 0}, [first], []
    for states in order:
        targets = [set(first) for _ in example]
        for s in states:
            for classes, after in by_state[s]:
                for c in classes:
                    targets[c] |= after
        row = []
        for t in map(frozenset, targets):
            if t not in number:
                number[t] = len(order)
                order.append(t)
            row.append(number[t])
        rows.append(row)
    step = np.array(rows, np.int64)
    accepts = np.array([sum(ends.get(s, 0) for s in states) for states in order], np.int64)

    # Minimisation: split classes of states until members agree on the class of each successor.
    part = np.unique(accepts, return_inverse=True)[1].ravel()
    while True:
        _, finer = np.unique(np.column_stack([part, part[step]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == part.max():
            break
        part = finer
    _, member = np.unique(part, return_index=True)
    step, accepts, start = part[step[member]][:, class_of.ravel()], accepts[member], int(part[0])
    return Automaton((step * 256).astype(np.int32).ravel(), accepts, start * 256, (step == start).all(axis=0))


def hits(data, ends, automaton):
    """Stretches of the bytes in which a rule is accepted: arrays of their starts, stops and rule bits.

    ``ends``: where texts end; a stretch never reaches over one of them.
    """
    cut = np.concatenate([np.flatnonzero(automaton.resets[data]), ends - 1])
    stop = np.unique(cut[cut >= 0]) + 1
    start = np.concatenate([[0], stop[:-1]])
    length = stop - start
    # A stretch of a byte or two cannot hold a match; the longest stretches come first.
    order = np.argsort(-length, kind="stable")
    order = order[:np.searchsorted(-length[order], -4, side="right")]
    start, stop, length = start[order], stop[order], length[order]
    long = int(np.searchsorted(-length, -LONG, side="left"))
    seen = np.zeros(len(start), np.int64)
    for k in range(long):
        seen[k] = _long(data[start[k]:stop[k]], automaton)
    state = np.full(len(start) - long, automaton.start, np.int32)
    bits = automaton.accepts
    accepting = bits != 0
    first, found_in, live, t = start[long:], seen[long:], len(start) - long, 0
    falling = -length[long:]
    while live:
        live = int(np.searchsorted(falling, -t, side="left"))  # stretches longer than t
        if not live:
            break
        here = automaton.step.take(state[:live] + data.take(first[:live] + t))
        state[:live] = here
        found = np.flatnonzero(accepting.take(here >> 8))
        if len(found):
            found_in[found] |= bits.take(here[found] >> 8)
        t += 1
    kept = np.flatnonzero(seen)
    return start[kept], stop[kept], seen[kept]


def _long(data, automaton):
    """Rule bits of one long stretch: parts of it advance in lockstep, and are then put right from their true entry states."""
    seen, entry = 0, automaton.start
    for at in range(0, len(data), PART * PARTS):
        path = paths(data[at:at + PART * PARTS], entry, automaton)
        entry = int(path[-1]) * 256
        seen |= int(np.bitwise_or.reduce(automaton.accepts[np.unique(path)]))
    return seen


def paths(data, entry, automaton):
    """The state (without its factor) after each byte of a stretch that is entered in the state ``entry``.

    All parts but the first start as if nothing stood before them. A part whose true entry state, the last one
    of the part before, is another runs again until both runs agree, which is soon: what a state
    remembers is short. Where it is not, as within an endless run of one kind of character, the
    parts behind are tried from the same entry state at once.
    """
    n = -(-len(data) // PART)
    rows = np.zeros((n, PART), np.uint8)
    rows.ravel()[:len(data)] = data
    size = np.full(n, PART)
    size[-1] = len(data) - (n - 1) * PART
    path = np.empty((PART, n), np.int16)
    start = np.full(n, automaton.start, np.int32)
    start[0] = entry

    def run(parts, again):
        state, t = start[parts], 0
        while len(parts):
            state = automaton.step.take(state + rows[parts, t])
            now = (state >> 8).astype(np.int16)
            if again:
                open_ = now != path[t, parts]
                parts, state, now = parts[open_], state[open_], now[open_]
            path[t, parts] = now
            t += 1
            if t == PART:
                break
            more = size[parts] > t
            if not more.all():
                parts, state = parts[more], state[more]

    run(np.arange(n), False)
    rounds = 0
    while True:
        true = np.append(start[0], path[size - 1, np.arange(n)][:-1].astype(np.int32) * 256)
        wrong = np.flatnonzero(true != start)
        if not len(wrong):
            return path.T.ravel()[:len(data)]
        if rounds >= 2:  # everything up to the first wrong part is settled; its entry is a guess for all behind it
            wrong = np.arange(wrong[0], n)
            true[wrong] = true[wrong[0]]
            wrong = wrong[start[wrong] != true[wrong]]
        start[wrong] = true[wrong]
        run(wrong, True)
        rounds += 1


@functools.lru_cache(maxsize=4)
def _exact(rules):
    return [re.compile(rule.exact.encode()) for rule in rules]


def spans(texts, rules=RULES):
    """Per text of an Arrow column a list of (start, kind number, end) in code points, sorted."""
    automaton, exact = compile_rules(rules), _exact(rules)
    data, at = utf8(texts)
    found = [[] for _ in range(len(texts))]
    if not len(data):
        return found
    starts, stops, seen = hits(data, at[1:], automaton)
    row_of = np.searchsorted(at, starts, side="right") - 1
    points, searched = None, set()
    for start, stop, bits, row in sorted(zip(starts.tolist(), stops.tolist(), seen.tolist(), row_of.tolist())):
        if points is None or points[0] != row:
            lead = (data[at[row]:at[row + 1]] & 0xC0) != 0x80
            points = row, np.concatenate([[0], np.cumsum(lead)])
        piece = data[start:stop].tobytes()
        for kind, rule in enumerate(rules):
            if bits >> kind & 1 and (row, kind) not in searched:
                lead, where = start - at[row], piece
                if rule.whole:  # once per text
                    searched.add((row, kind))
                    lead, where = 0, data[at[row]:at[row + 1]].tobytes()
                for m in exact[kind].finditer(where):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        a, b = points[1][lead + np.array(m.span())].tolist()
                        found[row].append((a, kind, b))
    return [sorted(f) for f in found]


def scan(docs, id_col="doc_id", text_col="text", rules=RULES):
    """All secrets of each text: id column and ``spans`` array<struct<kind, start, end>> by start and kind.

    Positions are code points, the end exclusive. A null text is empty and has none; every
    row gives one row, repeated ones too; other columns are not read.
    """
    kinds = [r.kind for r in rules]

    def run(batches):
        item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for part in slices(batches, 1, BLOCK_BYTES):
            found = [[{"kind": kinds[k], "start": a, "end": b} for a, k, b in f] for f in spans(part.column(1), rules)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(item))], [id_col, "spans"])

    source = docs.select(F.col(id_col), F.col(text_col))
    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def digests(found):
    """Counts per base kind, the digest of the base spans, and all spans as one string."""
    def written(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[number(k) for k in BASE],
                        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(docs, text_col="text", mark="[SECRET]", rules=RULES, length_col=None):
    """The rows with every secret in the text replaced by a mark; all columns keep their place.

    Overlapping spans are replaced as one. A null text stays null. ``length_col``, where there is
    such a column, gets the code points of a text that changed.
    """
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for part in slices(batches, at, BLOCK_BYTES):
            texts, changed = part.column(at).to_pylist(), []
            for row, found in enumerate(spans(part.column(at), rules)):
                if found:
                    texts[row] = _masked(texts[row], found, mark)
                    changed.append(row)
            columns = list(part.columns)
            columns[at] = pa.array(texts, columns[at].type)
            if length_col in names:
                place = names.index(length_col)
                lengths = columns[place].to_pylist()
                for row in changed:
                    lengths[row] = len(texts[row])
                columns[place] = pa.array(lengths, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)


def _masked(text, found, mark):
    out, done = [], 0
    for start, _, end in found:
        if start >= done:
            out += [text[done:start], mark]
        done = max(done, end)
    return "".join([*out, text[done:]])
