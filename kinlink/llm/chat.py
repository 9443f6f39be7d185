"""Transcript parsing by a hidden Markov model over speaker markers and lines.

States are a role and whether a line opens its turn. Emissions are a line's
speaker marker and whether it is of the transcript's own style, its length
class, a blank line before it, and the marks at its ends and at the end of
the line before; all probabilities are counted on labelled transcripts.
Viterbi's best path gives turns and roles, also where markers are missing,
and turns are rendered in one canonical form.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm.common import load, parts

#: Any role but the first four is "other", and named as its marker names it.
ROLES = ("system", "user", "assistant", "tool", "other")
MARKED = {"system": ("system", "instructions"), "user": ("user", "human", "question", "q"), "assistant": ("assistant", "ai", "bot", "answer", "a"), "tool": ("tool", "function", "observation")}
ROLE_OF = {w: k for k, r in enumerate(ROLES[:-1]) for w in MARKED[r]}
MARKER = re.compile(r"^\s*(#{1,4}\s*|\*\*|<|\[|\()?([^\W\d_][\w -]{0,30}?)(\*\*|>|\]|\))?[ \t]*(:|>)(?:\*\*)?[ \t]*")
#: How transcripts are written down: decoration around a name, and the name of each role; one style a conversation.
STYLES = (
    ("{}: ", ("System", "User", "Assistant", "Tool")), ("### {}: ", ("Instructions", "Human", "Assistant", "Function")), ("[{}]: ", ("system", "user", "bot", "tool")), ("**{}**: ", ("System", "Q", "A", "Observation")),
)
SAMPLE = 20_000
#: Values of each feature of a line: marker (none, each role's in the own style, each role's in another), length class, and four yes-or-no ones.
SIZES = (2 * len(ROLES) + 1, 4, 2, 2, 2, 2)
OFFSETS = np.cumsum((0, *SIZES))
STATES = 2 * len(ROLES)  # role, role continued
CLOSING = tuple(".!?…:;\"'”»)")


def role_of(role: str | None) -> int:
    """Place in ROLES; a null role is the user."""
    return 1 if role is None else ROLES.index(role) if role in ROLES[:-1] else len(ROLES) - 1


def transcript(conv_id, turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[str, bool]]]:
    """A conversation written down, and the (role, opens a turn) of each line.

    The style hangs on the id; one turn in ten, never the first, lacks its marker.
    """
    form, names = STYLES[zlib.crc32(str(conv_id).encode()) % len(STYLES)]
    lines, truth = [], []
    for k, (role, text) in enumerate(turns):
        at = role_of(role)
        bare = k and at < len(ROLES) - 1 and zlib.crc32(f"{conv_id}:{k}".encode()) % 10 == 0
        marker = "" if bare else form.format(names[at] if at < len(names) else role)
        for j, line in enumerate((text or "").split("\n")):
            lines.append(("" if j else marker) + line)
            truth.append((ROLES[at], j == 0))
        if zlib.crc32(f"{conv_id}/{k}".encode()) % 2:
            lines.append("")
            truth.append((ROLES[at], False))
    return "\n".join(lines), truth


def features(lines: list[str]) -> np.ndarray:
    """Each line's features as columns of the emission table.

    A marker is of the transcript's own style if it is decorated as the first
    one, and the role's name is the one that such a marker gave it first.
    """
    out = np.zeros((len(lines), len(SIZES)), np.int64)
    own, names, before = None, {}, ""
    for i, line in enumerate(lines):
        if found := MARKER.match(line):
            word = found[2].lower()
            role = ROLE_OF.get(word, len(ROLES) - 1)
            decoration = (found[1] or "").strip(), found[3], found[4], found[2][0].isupper()
            own = own or decoration
            same = decoration == own and (role == len(ROLES) - 1 or names.setdefault(role, word) == word)
            out[i, 0] = 1 + role + (0 if same else len(ROLES))
        out[i, 1] = 0 if not line.strip() else 1 if len(line) < 60 else 2 if len(line) < 240 else 3
        out[i, 2] = i > 0 and not before.strip()
        out[i, 3] = line.rstrip().endswith("?")
        out[i, 4] = line.lstrip()[:1].isupper()
        out[i, 5] = before.rstrip().endswith(CLOSING)
        before = line
    return out + OFFSETS[:-1]


def counts(lines: list[str], truth: list[tuple[str, bool]]) -> np.ndarray:
    """First states, transitions and emissions of one labelled transcript, in one vector."""
    first, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, OFFSETS[-1]))
    state = np.array([2 * ROLES.index(role) + (not opens) for role, opens in truth])
    first[state[0]] += 1
    np.add.at(move, (state[:-1], state[1:]), 1)
    np.add.at(emit, (state[:, None], features(lines)), 1)
    return np.concatenate((first, move.ravel(), emit.ravel()))


def marker_prior() -> np.ndarray:
    """What each state's marker is before any count: a turn opens with its role's own, other lines have none or quote another style."""
    n = len(ROLES)
    prior = np.zeros((STATES, SIZES[0]))
    for k in range(n):
        opens, goes_on = prior[2 * k], prior[2 * k + 1]
        opens[:] = 0.04 / (2 * n - 2)
        opens[[0, 1 + k, 1 + n + k]] = 0.1, 0.8, 0.06
        goes_on[0], goes_on[1 : 1 + n], goes_on[1 + n :] = 0.9, 0.02 / n, 0.08 / n
    return prior


class Model:
    """Log probabilities from counts, one added to each; a marker's are drawn to their prior by 5 counts and a five-hundredth, so a rare state is no refuge for a rare marker."""

    def __init__(self, total: np.ndarray):
        first, move, emit = np.split(total, (STATES, STATES + STATES**2))
        norm = lambda x: np.log((x + 1) / (x + 1).sum(-1, keepdims=True))
        self.first, self.move = norm(first), norm(move.reshape(STATES, STATES))
        e = emit.reshape(STATES, -1)
        marks = e[:, : SIZES[0]]
        pull = 5 + 0.002 * marks.sum(1, keepdims=True)
        marks = np.log((marks + pull * marker_prior()) / (marks.sum(1, keepdims=True) + pull))
        self.emit = np.concatenate([marks, *(norm(e[:, a:b]) for a, b in zip(OFFSETS[1:], OFFSETS[2:], strict=False))], 1)
        for k, _ in enumerate(ROLES):  # a turn's continuation follows its own role only
            for other in range(STATES):
                if other // 2 != k:
                    self.move[other, 2 * k + 1] = -1e9
        self.first[1::2] = -1e9
        # An unknown role has no name but its marker's.
        self.emit[STATES - 2, [0, *range(1, len(ROLES))]] = -1e9

    def viterbi(self, lines: list[str]) -> list[int]:
        emitted = self.emit[:, features(lines)].sum(2)
        score, back = self.first + emitted[:, 0], np.zeros((len(lines), STATES), np.int8)
        for i in range(1, len(lines)):
            way = score[:, None] + self.move
            back[i] = way.argmax(0)
            score = way.max(0) + emitted[:, i]
        path = [int(score.argmax())]
        for i in range(len(lines) - 1, 0, -1):
            path.append(int(back[i, path[-1]]))
        return path[::-1]


def turns_of(lines: list[str], path: list[int]) -> list[tuple[str, str]]:
    """(role, text) of each recovered turn; an opening line's marker of that role goes, outer blank lines too."""
    turns: list[tuple[str, list[str]]] = []
    for line, state in zip(lines, path, strict=True):
        if state % 2 == 0 or not turns:
            role, found = state // 2, MARKER.match(line)
            marked = found and ROLE_OF.get(found[2].lower(), len(ROLES) - 1) == role
            turns.append((found[2] if marked and role == len(ROLES) - 1 else ROLES[role], [line[found.end() :] if marked else line]))
        else:
            turns[-1][1].append(line)
    return [(r, "\n".join(x).strip("\n")) for r, x in turns]


def render(turns: list[tuple[str, str]]) -> str:
    """Canonical form; marker strings inside texts are parted so they can't open a turn."""
    return "".join(f"<|im_start|>{r}\n{t.replace('<|im_', '<| im_')}<|im_end|>\n" for r, t in turns)


def written(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: each conversation's (turn, role, text) in order of turn, then role and text.

    Rows without a conv_id say nothing of who they belong to: each is a
    conversation of its own, so however many there are none is gathered.
    """
    turn = F.struct("turn", "role", "text")
    named = conversations.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return named.unionAll(conversations.where("conv_id IS NULL").select("conv_id", F.array(turn).alias("turns")))


def held_out(conv_id: str = "conv_id") -> F.Column:
    """crc32(conv_id as text) mod 4 is 2: conversations that the model isn't counted on."""
    return F.coalesce(F.crc32(F.col(conv_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(conversations: DataFrame, sample: int = SAMPLE) -> Model:
    """Count on the ``sample`` conversations of smallest hash at most, of those that aren't held out."""
    some = conversations.where("conv_id IS NOT NULL").where(~held_out()).select("conv_id").distinct().orderBy(F.xxhash64("conv_id"), "conv_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for conv_id, turns in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text, truth = transcript(conv_id, [(t["role"], t["text"]) for t in turns])
                c = counts(text.split("\n"), truth)
                total = c if total is None else total + c
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total, pa.float64())], names=["at", "n"])

    total = np.zeros(STATES + STATES**2 + STATES * OFFSETS[-1])
    for r in written(conversations.join(F.broadcast(some), "conv_id", "left_semi")).mapInArrow(run, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():  # one row a parameter
        total[r["at"]] = r["n"]
    return Model(total)


def parse(conversations: DataFrame, model: Model) -> DataFrame:
    """One row per conversation: conv_id, held_out, n_turns, n_lines, agreement, exact, rendered.

    Each conversation is written down as a plain transcript and recovered from
    it alone; ``agreement`` is the share of lines whose role the path gets
    right, ``exact`` whether all turns come back with their roles and texts
    (but for line feeds at their ends). Null roles count as user, other roles
    keep their names, null texts are empty; rows without a conv_id are
    conversations of their own; repeated rows are repeated turns; texts of any
    length are read whole; other columns are not read; an empty table gives no
    rows.
    """
    shared = conversations.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "turns", 8 << 20):
            rows = []
            for conv_id, turns in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                given = [(t["role"], t["text"]) for t in turns]
                text, truth = transcript(conv_id, given)
                lines = text.split("\n")
                path = shared.value.viterbi(lines)
                found = turns_of(lines, path)
                right = sum(ROLES[s // 2] == role for s, (role, _) in zip(path, truth, strict=True))
                whole = found == [("user" if r is None else r, (t or "").strip("\n")) for r, t in given]
                rows.append((conv_id, len(found), len(lines), right / len(lines), whole, render(found)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.bool_(), pa.string()), strict=True)], names=["conv_id", "n_turns", "n_lines", "agreement", "exact", "rendered"])

    made = written(conversations).mapInArrow(run, "conv_id long, n_turns int, n_lines int, agreement double, exact boolean, rendered string")
    return made.select("conv_id", held_out().alias("held_out"), "n_turns", "n_lines", "agreement", "exact", "rendered")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = load(spark, sf_dir, "conversations")
    return parse(conversations, fit(conversations))
