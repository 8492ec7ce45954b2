"""Accounts whose archives are kept, and which of them is active.

Tables live under ``base``: ``registry`` (one row an account, with its place and whether it is active),
and for each account a folder of its own, named by its store key, with its archive and index. Access
tokens are never stored.
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from quillspark.operators import index
from quillspark.operators.cards import index_docs
from quillspark.sources.place import delete, publish, published
from quillspark.streaming import ingest

REGISTRY = "place int, instance_url string, acct string, account_id string, active boolean"


@dataclass(frozen=True)
class Account:
    instance_url: str
    acct: str
    account_id: str

    @property
    def key(self) -> str:
        """Ids are unique within an instance only."""
        return f"store:{self.instance_url}:{self.account_id}"


@dataclass(frozen=True)
class Opened:
    account: Account
    statuses: DataFrame
    index: index.Index


class Sessions:
    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")

    def folder(self, key: str) -> str:
        return f"{self.base}/{quote(key, safe='')}"

    def _read(self, name: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.base}/{name}")
        except AnalysisException:
            return None

    def _rows(self) -> list:
        rows = published(self.spark, f"{self.base}/registry", REGISTRY)
        if rows is not None:
            return sorted(rows, key=lambda r: r["place"])  # one row an account of this user
        legacy = self._read("account", "instance_url string, acct string, account_id string")
        row = legacy.first() if legacy is not None else None
        if row is None:
            return []
        return self._save([Account(*row)], Account(*row).key)  # a store from before there were several

    def _save(self, accounts: list[Account], active: str | None) -> list:
        rows = [(k, a.instance_url, a.acct, a.account_id, a.key == active) for k, a in enumerate(accounts)]
        publish(self.spark.createDataFrame(rows, REGISTRY), f"{self.base}/registry")
        return self._rows()

    def accounts(self) -> list[Account]:
        return [Account(r["instance_url"], r["acct"], r["account_id"]) for r in self._rows()]

    def active(self) -> str | None:
        return next((Account(r["instance_url"], r["acct"], r["account_id"]).key for r in self._rows() if r["active"]), None)

    def activate(self, key: str | None) -> None:
        self._save(self.accounts(), key)

    def add(self, account: Account) -> str:
        """Adds or refreshes an account and makes it active; its archive stays as it is."""
        kept = self.accounts()
        at = next((k for k, a in enumerate(kept) if a.key == account.key), len(kept))
        self._save([*kept[:at], account, *kept[at + 1 :]], account.key)
        return account.key

    def remove(self, key: str) -> None:
        """Drops an account with its archive and index; if it was active, the first left becomes so."""
        active, kept = self.active(), [a for a in self.accounts() if a.key != key]
        delete(self.spark, self.folder(key))
        self._save(kept, (kept[0].key if kept else None) if active == key else active)

    def open(self) -> Opened | None:
        """The active account with its statuses and index, which is built or grown if it does not fit; nothing
        if no account is active. An active key that is no account falls back to the first one."""
        kept = self.accounts()
        if not kept:
            return None
        active = self.active()
        account = next((a for a in kept if a.key == active), kept[0])
        if account.key != active:
            self.activate(account.key)
        base = self.folder(account.key)
        stored = ingest.statuses(self.spark, base)
        return Opened(account, stored, index.load_or_build(self.spark, f"{base}/index", index_docs(stored)))

    def switch(self, key: str) -> Opened | None:
        """Makes another account the active one and opens it; an unknown key changes nothing."""
        if key in {a.key for a in self.accounts()}:
            self.activate(key)
        return self.open()
