"""Commits that shell commands of a session made, from what their results print.

The fold over one session's messages is sequential by nature, so it runs in Python, one group for each session in the
order of its messages; rows that can't matter are filtered before they are shuffled.
"""

from __future__ import annotations

import json
import re
import shlex
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tallyloom.operators.digest import COMMIT, SHELL_TOOLS

MAX_PENDING = 16
SEPARATORS = ("&&", "||", ";", "|", "\n", "&")
#: Git subcommands that make a commit, that move HEAD otherwise, and that print HEAD.
MAKERS = frozenset(["commit", "cherry-pick", "revert"])
MOVERS = frozenset(["checkout", "switch", "reset", "rebase", "merge", "pull", "am", "bisect", "stash"])
REVEALS = frozenset(["rev-parse", "log", "show", "push"])
WRAPPERS = ("bash -lc ", "bash -c ", "sh -c ", "zsh -lc ", "zsh -c ", "/bin/bash -lc ", "/bin/zsh -lc ", "/bin/sh -c ")
_PRINTED = re.compile(COMMIT)
_HEX = re.compile(r"\b([0-9a-f]{7,40})\b")
_PUSHED = re.compile(r"\b[0-9a-f]{7,40}\.\.([0-9a-f]{7,40})\b")

SCHEMA = "conversation_id string, hash string, operation string, command_id string, result_id string, reveal_id string, directory string, outcome string"


def split_shell(command: str) -> list[tuple[str, str]]:
    """(simple command, the separator after it) of a shell line: quotes, $( ) and here-documents are kept whole."""
    out, current, i, depth, quote = [], "", 0, 0, ""
    while i < len(command):
        c = command[i]
        if quote:
            if c == "\\" and quote == '"':
                current += command[i : i + 2]
                i += 2
                continue
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "\\":
            current += command[i : i + 2]
            i += 2
            continue
        elif command.startswith("$(", i) or c == "(":
            depth += 1
        elif c == ")" and depth:
            depth -= 1
        elif not depth and (here := re.match(r"<<-?\s*(['\"]?)(\w+)\1", command[i:])):
            end = re.search(rf"\n\s*{here[2]}(?=\n|$)", command[i:])
            stop = i + end.end() if end else len(command)
            current += command[i:stop]
            i = stop
            continue
        elif not depth and (sep := next((s for s in SEPARATORS if command.startswith(s, i)), None)):
            if current.strip():
                out.append((current.strip(), sep))
            current, i = "", i + len(sep)
            continue
        current += c
        i += 1
    if current.strip():
        out.append((current.strip(), ""))
    return out


def unwrap(command: str) -> str:
    for w in WRAPPERS:
        if command.startswith(w):
            rest = command[len(w) :].strip()
            return rest[1:-1] if rest[:1] in "'\"" and rest[-1:] == rest[:1] and len(rest) > 1 else rest
    return command


@dataclass
class Call:
    """What a shell line does with git, as far as it can be read."""

    id: str
    operation: str = ""
    reveals: str = ""
    moves: bool = False
    directory: str = ""
    compound: bool = False
    parts: int = 0
    piped: bool = False


def read_call(id_: str, command: str) -> Call:
    call, cwd = Call(id_), ""
    for part, sep in split_shell(unwrap(command)):
        call.parts += 1
        call.piped |= sep in ("|", "&")
        try:
            words = shlex.split(part, comments=False)
        except ValueError:
            call.compound = True
            continue
        while words and re.match(r"[A-Za-z_]\w*=", words[0]):
            words = words[1:]
        if not words:
            continue
        if words[0] == "cd" and len(words) == 2:
            cwd = words[1] if words[1].startswith("/") or not cwd else f"{cwd.rstrip('/')}/{words[1]}"
            continue
        if words[0] != "git":
            call.compound |= words[0] not in ("echo", "true", "export", "set", "pwd")
            continue
        words, where = words[1:], cwd
        while words and words[0].startswith("-"):
            if words[0] == "-C" and len(words) > 1:
                where = words[1] if words[1].startswith("/") else f"{cwd.rstrip('/')}/{words[1]}" if cwd else words[1]
            words = words[2:] if words[0] in ("-C", "-c", "--git-dir", "--work-tree") else words[1:]
        verb = words[0] if words else ""
        if verb in MAKERS and not {"--dry-run", "-n", "--no-commit", "--abort", "--quit"} & set(words):
            call.moves |= bool(call.operation)
            call.operation, call.directory = verb, where
        elif verb in MOVERS:
            call.moves = True
        elif verb in REVEALS and (verb != "log" or "-1" in words or "-n1" in words) and (verb != "rev-parse" or "HEAD" in words):
            call.reveals, call.directory = verb, call.directory or where
    return call


def command_of(text: str, enrichment: str | None) -> str:
    """The shell command of a tool call: its argument command or cmd, a string or a list; else what its enrichment records."""
    try:
        args = json.loads(text) if text and text.lstrip().startswith("{") else {}
    except ValueError:
        args = {}
    for key in ("command", "cmd"):
        value = args.get(key) if isinstance(args, dict) else None
        if isinstance(value, list):
            value = " ".join(x for x in value if isinstance(x, str))
        if isinstance(value, str) and value:
            return unwrap(value)
    try:
        recorded = json.loads(enrichment).get("commands", []) if enrichment else []
    except (ValueError, AttributeError):
        recorded = []
    return "; ".join(c["cmd"] for c in recorded if isinstance(c, dict) and c.get("cmd"))


def output_of(text: str) -> tuple[str, int | None]:
    """The printed text and the exit code of a result: plain, or JSON with output and exit_code."""
    if text and text.lstrip().startswith("{") and '"exit_code":' in text:
        try:
            found = json.loads(text)
            meta = found.get("metadata") if isinstance(found.get("metadata"), dict) else found
            return str(found.get("output", "")), meta.get("exit_code")
        except (ValueError, AttributeError):
            return text, None
    m = re.search(r"(?m)^(?:Exit code|exit code|Process exited with code)[: ]+(\d+)", text or "")
    return text or "", int(m[1]) if m else None


def printed_hashes(output: str) -> list[str]:
    return list(dict.fromkeys(_PRINTED.findall(output)))


def revealed_hash(verb: str, output: str) -> str:
    line = output.strip().split("\n")[0] if output.strip() else ""
    if verb == "push":
        m = _PUSHED.search(output)
        return m[1] if m else ""
    m = re.match(r"(?:commit )?([0-9a-f]{7,40})\b", line)
    return m[1] if m else ""


@dataclass
class State:
    """What the fold carries: calls without a result, and the commit whose hash is not known yet."""

    pending: dict[str, Call] = field(default_factory=dict)
    open: dict | None = None

    def step(self, m: dict) -> list[dict]:
        if m["superseded"]:
            self.open = None
            return []
        if m["kind"] == "tool_call":
            if m["tool_call_id"] and (m["tool_name"] or "").lower() in SHELL_TOOLS:
                self.pending[m["tool_call_id"]] = read_call(m["id"], command_of(m["text"], m["enrichment"]))
                while len(self.pending) > MAX_PENDING:
                    self.pending.pop(next(iter(self.pending)))
            return []
        call = self.pending.pop(m["tool_call_id"], None) if m["kind"] == "tool_result" else None
        if call is None:
            return []
        output, code = output_of(m["text"])
        failed = bool(m["is_error"]) or bool(code)
        outcome = "failed" if failed else "succeeded" if code == 0 or m["is_error"] is False else "unknown"
        event = {"operation": call.operation or "unknown", "command_id": call.id, "result_id": m["id"], "reveal_id": None, "directory": call.directory, "outcome": outcome}
        events = []
        if call.operation and not call.compound and not call.piped:
            events = [event | {"hash": h} for h in printed_hashes(output)]
        if events:
            self.open = None
        elif call.reveals and not call.compound and not failed:
            found = revealed_hash(call.reveals, output)
            if found and call.operation:
                events, self.open = [event | {"hash": found}], None
            elif found and self.open is not None and self.open["directory"] == call.directory:
                events, self.open = [self.open | {"hash": found, "reveal_id": m["id"]}], None
        elif call.operation and not failed and not call.compound:
            self.open = event
        if call.moves or call.compound:
            self.open = None
        return events


def text_that_matters(text: str = "text"):
    """The text of a call, and of a result that can give a hash or an exit code; other results' texts are not needed."""
    code = F.col(text).contains('"exit_code":') | F.col(text).rlike("(?m)^(?:[Ee]xit code|Process exited with code)[: ]+[0-9]")
    return F.when((F.col("kind") == "tool_call") | F.col(text).rlike("[0-9a-fA-F]{7}") | code, F.col(text)).otherwise(F.lit("")).alias(text)


def commit_evidence(messages: DataFrame) -> DataFrame:
    """One row for each observed commit."""
    from tallyloom.sources.shipping import ship

    ship(messages.sparkSession)
    rows = messages.where(F.col("kind").isin("tool_call", "tool_result")).select("conversation_id", "id", "ordinal", "kind", "tool_name", "tool_call_id", "is_error", text_that_matters(), "superseded", "enrichment")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = State(), []
        for m in pdf.sort_values(["ordinal", "id"]).to_dict("records"):
            m = {k: None if v is None or v is pd.NA or v != v else v for k, v in m.items()}
            out += [e | {"conversation_id": m["conversation_id"]} for e in state.step(m)]
        return pd.DataFrame(out, columns=["conversation_id", "hash", "operation", "command_id", "result_id", "reveal_id", "directory", "outcome"])

    return rows.groupBy("conversation_id").applyInPandas(fold, SCHEMA)


def trace(evidence: DataFrame, hashes: list[str]) -> DataFrame:
    """wanted, and the evidence whose (possibly short) hash begins it: the hashes' prefixes of seven and more meet by equality."""
    wanted = sorted({h.lower() for h in hashes})
    if not 0 < len(wanted) <= 100 or not all(re.fullmatch("[0-9a-f]{40}|[0-9a-f]{64}", h) for h in wanted):
        raise ValueError("1 to 100 full commit ids are needed")
    rows = evidence.sparkSession.createDataFrame([(h,) for h in wanted], "wanted string")
    return trace_all(evidence, rows)


def trace_in(evidence: DataFrame, sessions: DataFrame, hashes: list[str], remote: str, limit: int = 20) -> DataFrame:
    """The same within the visible sessions of one repository, at most `limit` (100) by conversation and result."""
    own = sessions.where((F.col("remote") == remote) & F.col("hidden_at").isNull()).select(F.col("id").alias("conversation_id"))
    return trace(evidence, hashes).join(own, "conversation_id", "left_semi").orderBy("conversation_id", "result_id").limit(min(limit, 100))


def trace_all(evidence: DataFrame, wanted: DataFrame) -> DataFrame:
    prefixes = wanted.select("wanted", F.explode(F.expr("transform(sequence(7, length(wanted)), n -> left(wanted, n))")).alias("hash"))
    return prefixes.join(evidence, "hash")
