"""Requests against registered message tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import connection_verdict, detect_provider, server, service_status, suggest_hosts
from ..functions.text import count_or
from ..operators import enrich, mutate, select
from ..sources.messages import providers, stored


class RequestError(ValueError):
    """A request that lacks an argument, or names a connection that isn't there."""


class Engine:
    """Message tables under connection names. Results are lazy DataFrames."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._tables: dict[str, DataFrame] = {}

    def register(self, connection: str, messages: DataFrame, view: bool = False) -> None:
        """A name can be used once; view also makes it a temporary view for SQL."""
        if not connection:
            raise RequestError("a connection name is needed")
        if connection in self._tables:
            raise RequestError(f"there is a connection {connection} already")
        self._tables[connection] = messages
        if view:
            messages.createOrReplaceTempView(connection)

    def connect(self, connection: str, address: str, password: str, messages: DataFrame, provider: str | None = None, custom_host: str | None = None, custom_port: int | None = None) -> DataFrame:
        """Registers messages as those of an address, and returns (connectionId, email, provider, host,
        port). Without a name, an address or a password it is refused; the password isn't kept."""
        if not address or not password:
            raise RequestError("a connection needs an address and a password")
        self.register(connection, messages)
        asked = self.spark.createDataFrame([(connection, address, provider, custom_host, custom_port)], "connectionId string, email string, provider string, host string, port int")
        found = asked.withColumn("s", server("email", "provider", "host", "port"))
        return found.select("connectionId", "email", F.coalesce(F.nullif("provider", F.lit("")), detect_provider("email")).alias("provider"), "s.host", "s.port")

    def unregister(self, connection: str) -> None:
        self.table(connection)
        del self._tables[connection]
        self.spark.catalog.dropTempView(connection)

    def close(self) -> None:
        for connection in list(self._tables):
            self.unregister(connection)

    def connected(self, connection: str) -> bool:
        return connection in self._tables

    def table(self, connection: str) -> DataFrame:
        if connection not in self._tables:
            raise RequestError(f"no connection {connection}")
        return self._tables[connection]

    def connections(self) -> DataFrame:
        return self.spark.createDataFrame([(name, True) for name in self._tables], "connectionId string, connected boolean")

    def providers(self) -> DataFrame:
        return providers(self.spark).select("key", "name")

    def mailboxes(self, connection: str) -> DataFrame:
        return select.mailboxes(self.table(connection))

    def recent(self, connection: str, mailbox: str = select.INBOX, count: int = select.RECENT, include_to: bool = False) -> DataFrame:
        return select.summary(select.tail(select.open_box(self.table(connection), mailbox), count), include_to)

    def search(self, connection: str, criteria, mailbox: str = select.INBOX, limit: int = select.FOUND, include_to: bool = False) -> DataFrame:
        if criteria is None or criteria == "":
            raise RequestError("criteria are needed")
        return select.summary(select.tail(select.search(self.table(connection), criteria, mailbox), limit), include_to)

    def search_counts(self, connection: str, criteria, mailbox: str = select.INBOX, limit: int = select.FOUND) -> DataFrame:
        return select.counts(select.search(self.table(connection), criteria, mailbox), limit)

    def details(self, connection: str, uids: Iterable[int] | DataFrame, mailbox: str = select.INBOX) -> DataFrame:
        """A message without a date is shown with the present one."""
        return select.fetch(self.table(connection), uids, mailbox).withColumn("date", select.date_or_now())

    def delete(self, connection: str, uids: Iterable[int], mailbox: str = select.INBOX, move_to_trash: bool = True) -> tuple[str, int]:
        """(method, affected); the connection's table is the new one from then on."""
        if isinstance(uids, (str, bytes)) or uids is None:
            raise RequestError("uids must be a list")
        self._tables[connection], method, affected = mutate.trash(self.table(connection), uids, mailbox, move_to_trash)
        return method, affected

    def delete_stored(self, connection: str, path: str, uids: Iterable[int], mailbox: str = select.INBOX, move_to_trash: bool = True) -> tuple[str, int]:
        """The same, written back to the stored table at a path, which the connection then reads."""
        if isinstance(uids, (str, bytes)) or uids is None:
            raise RequestError("uids must be a list")
        self.table(connection)
        done = mutate.write_back(self.spark, path, uids, mailbox, move_to_trash)
        self._tables[connection] = stored(self.spark, path)
        return done

    def status(self) -> DataFrame:
        """(success, activeConnections)."""
        return self.spark.createDataFrame([(True, len(self._tables))], "success boolean, activeConnections int")

    def test_connection(
        self, address: str, provider: str | None = None, custom_host: str | None = None, custom_port: int | None = None,
        tls: bool = True, tcp_error: str | None = None, tls_error: str | None = None, greeting: str | None = None,
    ) -> DataFrame:
        """(host, port, success, message, tcp, tls, suggestions) of what a probe of an address's server
        found; suggestions are other servers to try, null if it went well."""
        if not address:
            raise RequestError("an address is needed")
        asked = self.spark.createDataFrame([(address, provider, custom_host, custom_port, tls, tcp_error, tls_error, greeting)], "address string, provider string, host string, port int, tls boolean, tcp_error string, tls_error string, greeting string")
        found = asked.withColumn("s", server("address", "provider", "host", "port")).select("address", "s.*", "tls", "tcp_error", "tls_error", "greeting")
        out = found.withColumn("v", connection_verdict("host", "port", "tls", "tcp_error", "tls_error", "greeting"))
        return out.select("host", "port", "v.*", F.when(~F.col("v.success"), suggest_hosts("address")).alias("suggestions"))

    def service_status(self, error_code: str | None = None, error_text: str | None = None, models: list[str] | None = None) -> DataFrame:
        asked = self.spark.createDataFrame([(error_code, error_text, models)], "code string, text string, models array<string>")
        return asked.select(service_status("code", "text", "models").alias("s")).select("s.*")

    def analyze(self, connection: str, uids: Iterable[int], mailbox: str = select.INBOX, backend: enrich.Backend | None = None, status: str = "available") -> DataFrame:
        """Nothing is read unless the model service is available."""
        if status != "available":
            raise RequestError(f"the model service is {status}")
        return enrich.analyze(self.details(connection, uids, mailbox), backend)

    def count_from_form(self, text: str | None) -> int:
        return self.spark.range(1).select(count_or(F.lit(text)).alias("n")).first()["n"]
