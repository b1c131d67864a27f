"""An interactive shell: LOAD name path, TABLES, HELP, EXIT, or SQL."""

from __future__ import annotations

import sys
from collections.abc import Iterable

from pyspark.sql import SparkSession

from relspark.catalog import Catalog
from relspark.plans.explain import summary
from relspark.sources.dat import register

HELP = """LOAD name path   registers a .dat, .csv, .json or Parquet table (columns of .dat: A1, A2, ...)
TABLES           lists the tables
EXIT             ends (QUIT, Q)
anything else    SQL, e.g. SELECT T1.A1, COUNT(*) FROM T1 WHERE T1.A2 > 10 GROUP BY T1.A1"""


class Shell:
    def __init__(self, spark: SparkSession, rows: int = 50) -> None:
        register(spark)
        self.catalog, self.rows = Catalog(spark), rows

    def load(self, name: str, path: str) -> str:
        if name.upper() in self.catalog.tables():
            return f"{name} is loaded already"
        ending = path.rstrip("/").rpartition(".")[2].lower()
        reader = self.catalog.spark.read
        df = reader.csv(path, header=True, inferSchema=True) if ending == "csv" else reader.format(ending if ending in ("dat", "json", "orc") else "parquet").load(path)
        self.catalog.register(name, df)
        return f"{name}: {', '.join(df.columns)}"

    def run(self, line: str) -> str | None:
        """The answer to a line; None ends the session."""
        words = line.strip().rstrip(";").split()
        if not words:
            return ""
        head = words[0].upper()
        if head in ("EXIT", "QUIT", "Q") and len(words) == 1:
            return None
        try:
            if head in ("HELP", "?"):
                return HELP
            if head == "TABLES":
                return "\n".join(f"{n} ({self.catalog.arity(n)} columns)" for n in self.catalog.tables()) or "none"
            if head == "LOAD":
                return self.load(*words[1:3]) if len(words) == 3 else "LOAD name path"
            df = self.catalog.sql(line.strip().rstrip(";"))
            return f"{summary(df)}\n{df._show_string(self.rows, False, False)}"
        except Exception as e:  # noqa: BLE001  a mistake in a line doesn't end the session
            return f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"

    def loop(self, lines: Iterable[str]) -> None:
        for line in lines:
            answer = self.run(line)
            if answer is None:
                return
            if answer:
                print(answer)


if __name__ == "__main__":
    Shell(SparkSession.builder.appName("relspark").getOrCreate()).loop(sys.stdin)
