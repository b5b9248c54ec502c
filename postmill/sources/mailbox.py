"""A mailbox as a Spark data source: batch and stream, offsets by account as (uidvalidity, last_uid).

The reader works on a folder of ``account/uidvalidity/uid.eml`` files; a network reader would only
replace ``_accounts``, ``_epochs``, ``_uids`` and ``_fetch``. A partition holds up to ``SPAN`` uids of one
account. Sizes come from the files; with option ``bodies`` set to false no message is opened and raw is null.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "account STRING, uidvalidity LONG, uid LONG, size LONG, raw BINARY"
SPAN = 1000  # uids of one partition


def _accounts(root: str) -> list[str]:
    return sorted(os.listdir(root))


def _epochs(root: str, account: str) -> list[int]:
    return sorted(int(e) for e in os.listdir(os.path.join(root, account)))


def _uids(root: str, account: str, epoch: int) -> list[int]:
    return sorted(int(f[:-4]) for f in os.listdir(os.path.join(root, account, str(epoch))) if f.endswith(".eml"))


def _file(root: str, account: str, epoch: int, uid: int) -> str:
    return os.path.join(root, account, str(epoch), f"{uid}.eml")


def _fetch(root: str, account: str, epoch: int, uid: int) -> bytes:
    with open(_file(root, account, epoch, uid), "rb") as f:
        return f.read()


def list_folders(spark: SparkSession, root: str) -> DataFrame:
    """(account, uidvalidity, messages, last_uid) of each mailbox epoch; no message is opened."""
    rows = [(a, e, len(u), max(u, default=0)) for a in _accounts(root) for e in _epochs(root, a) for u in [_uids(root, a, e)]]
    return spark.createDataFrame(rows, "account string, uidvalidity long, messages long, last_uid long")


class Range(InputPartition):
    """The given uids of one account's epoch."""

    def __init__(self, account: str, epoch: int, uids: list[int]):
        super().__init__((account, epoch))
        self.account, self.epoch, self.uids = account, epoch, uids


def _ranges(root: str, account: str, epoch: int, low: int, high: int | None = None) -> list[Range]:
    wanted = [u for u in _uids(root, account, epoch) if u > low and (high is None or u <= high)]
    return [Range(account, epoch, wanted[k : k + SPAN]) for k in range(0, len(wanted), SPAN)]


def _rows(root: str, part: Range, bodies: bool):
    for uid in part.uids:
        raw = _fetch(root, part.account, part.epoch, uid) if bodies else None
        yield part.account, part.epoch, uid, os.path.getsize(_file(root, part.account, part.epoch, uid)), raw


class _Batch(DataSourceReader):
    def __init__(self, root: str, bodies: bool):
        self.root, self.bodies = root, bodies

    def partitions(self):
        return [r for a in _accounts(self.root) for e in _epochs(self.root, a) for r in _ranges(self.root, a, e, 0)]

    def read(self, partition):
        return _rows(self.root, partition, self.bodies)


class _Stream(DataSourceStreamReader):
    """Offsets never go back within an epoch; a new epoch starts from uid 0 and content dedup absorbs the overlap."""

    def __init__(self, root: str, limit: int, bodies: bool):
        self.root, self.limit, self.bodies = root, limit, bodies
        self.last: dict[str, list[int]] = {}

    def initialOffset(self):
        return {"at": json.dumps({})}

    def latestOffset(self):
        now = dict(self.last)
        for account in _accounts(self.root):
            epoch = max(_epochs(self.root, account))
            known = self.last.get(account, [epoch, 0])
            low = known[1] if known[0] == epoch else 0
            fresh = [u for u in _uids(self.root, account, epoch) if u > low][: self.limit]
            now[account] = [epoch, fresh[-1] if fresh else low]
        self.last = now
        return {"at": json.dumps(now, sort_keys=True)}

    def partitions(self, start, end):
        a, b = json.loads(start["at"]), json.loads(end["at"])
        self.last = b
        out = []
        for account, (epoch, high) in b.items():
            known = a.get(account, [epoch, 0])
            low = known[1] if known[0] == epoch else 0
            if high > low:
                out += _ranges(self.root, account, epoch, low, high)
        return out

    def read(self, partition):
        return _rows(self.root, partition, self.bodies)


class MailboxSource(DataSource):
    """``spark.dataSource.register(MailboxSource)``, then format("mailbox") with path, limit (rows a run and account) and bodies."""

    @classmethod
    def name(cls):
        return "mailbox"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options["path"], self.options.get("bodies", "true") == "true")

    def streamReader(self, schema):
        return _Stream(self.options["path"], int(self.options.get("limit", "500")), self.options.get("bodies", "true") == "true")
