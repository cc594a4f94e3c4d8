"""The same parsing over log lines as they arrive.

With known formats a line's entry depends on the line alone (:func:`stream_entries`). Where formats are not known, or
stages are to be carried, :func:`stream_logs` keeps a little state per source: the votes of its first lines, the last
stage and progress, and lines that are not settled yet.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodeglass.functions.formats import PLAIN, TIE_ORDER, line_class
from lodeglass.functions.formats.conversion import FIRST_STAGE
from lodeglass.functions.formats.conversion import FORMAT as CONVERSION
from lodeglass.functions.text import is_blank
from lodeglass.operators.carry import PROGRESS, STAGE, add_carried, line_marks
from lodeglass.operators.detect import LOOKED_AT, THRESHOLD, VOTERS
from lodeglass.operators.entries import parse_by_format, with_format, without_empty

_OUT = "source_id string, line_no long, value string, format string, stage string, progress_pct string"
_STATE = "kept string"


def stream_entries(spark: SparkSession, folder: str, formats: DataFrame) -> DataFrame:
    """Entries of text files that appear in ``folder``; ``formats`` is static. A source is a file."""
    text = spark.readStream.option("lineSep", "\n").text(folder)
    lines = text.select(F.col("_metadata.file_path").alias("source_id"), "value")
    return parse_by_format(with_format(without_empty(lines), formats))


class _Source:
    """What is known of one source: its votes, what holds after its last settled line, and lines that wait."""

    def __init__(self, kept: str | None):
        known = json.loads(kept) if kept else {}
        self.format: str | None = known.get("format")
        self.rank: int = known.get("rank", 0)
        self.votes: list[str | None] = known.get("votes", [])
        self.last_vote: int = known.get("last_vote", 0)
        self.stage: str | None = known.get("stage")
        self.progress: str | None = known.get("progress")
        #: settled in order, but without a format yet; and those that the watermark has not passed
        self.held: list[list] = known.get("held", [])
        self.waiting: list[list] = known.get("waiting", [])

    def dump(self) -> str:
        return json.dumps(self.__dict__)

    def vote(self, said: bool, cls: str | None) -> None:
        """The first ten lines that say something vote, if the one before is among the first nineteen."""
        self.rank += 1
        if said and self.format is None:
            self.votes.append(cls)
            self.last_vote = self.rank
            if len(self.votes) == VOTERS or self.last_vote > LOOKED_AT:
                self.decide()

    def decide(self) -> None:
        counts = {name: self.votes.count(name) for name in TIE_ORDER}
        best = max(TIE_ORDER, key=lambda name: counts[name])
        enough = self.votes and counts[best] / len(self.votes) >= THRESHOLD
        self.format = best if enough else PLAIN

    def settle(self, until: int) -> None:
        """Take the lines up to a time, in order."""
        ready = sorted(x for x in self.waiting if x[1] <= until)
        self.waiting = [x for x in self.waiting if x[1] > until]
        for line_no, _, value, said, cls, started, seen in ready:
            self.vote(said, cls)
            self.stage = self.stage if started is None else started
            self.progress = self.progress if seen is None else seen
            self.held.append([line_no, value, self.stage or FIRST_STAGE, self.progress or None])

    def told(self, source: str) -> pd.DataFrame:
        """Lines that have a format now."""
        rows = self.held if self.format else []
        self.held = [] if self.format else self.held
        return pd.DataFrame(
            [(source, n, value, self.format, stage, progress) for n, value, stage, progress in rows],
            columns=["source_id", "line_no", "value", "format", STAGE, PROGRESS],
        )


def _carry(idle: int):
    def carry(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        source = _Source(state.get[0] if state.exists else None)
        for frame in frames:
            rows = frame[["line_no", "_at", "value", "_said", "_class", "_started", "_seen"]].astype(object)
            source.waiting += rows.where(rows.notna(), None).values.tolist()
        passed = state.getCurrentWatermarkMs()
        source.settle(passed)
        quiet = state.hasTimedOut and not source.waiting
        if quiet and source.format is None:
            source.decide()
        yield source.told(key[0])
        if quiet:
            state.remove()
            return
        state.update((source.dump(),))
        # wakes up for the next line that waits, else after a quiet time
        wake = min((x[1] for x in source.waiting), default=passed + idle)
        state.setTimeoutTimestamp(max(wake, passed + 1))

    return carry


def stream_logs(lines: DataFrame, at: str = "at", delay: str = "1 minute", idle_seconds: int = 3600) -> DataFrame:
    """Entries of a stream of lines (``source_id, line_no, value`` and the time ``at`` which they were written), with the
    format of every source voted by its first lines, and stage and progress carried through conversion logs.

    Lines may arrive in any order within ``delay``: they wait until the watermark has passed them and are then taken by
    line number, which has to follow the time. Later ones are late and dropped, as Spark drops them. The lines of a
    source come out once its vote is complete. A source that is quiet for ``idle_seconds`` of that time is done: an
    incomplete vote is counted, and what comes later counts as a new source. The result is that of the batch job on the
    same lines. State is per source: a few values and the lines that wait.
    """
    line = F.col("value")
    marks = line_marks(line)
    known = lines.withWatermark(at, delay).select(
        "source_id", "line_no", "value", F.col(at),
        F.unix_millis(F.col(at)).alias("_at"), (~is_blank(line)).alias("_said"), line_class(line).alias("_class"),
        marks[STAGE].alias("_started"), marks[PROGRESS].alias("_seen"),
    )
    carried = known.groupBy("source_id").applyInPandasWithState(
        _carry(idle_seconds * 1000), _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    entries = parse_by_format(without_empty(carried))
    return add_carried(entries, F.col("format") == CONVERSION)
