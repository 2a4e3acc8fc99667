"""The few places where Spark SQL and the SQL of the checking engine differ."""

from __future__ import annotations


class Dialect:
    def __init__(self, spark: bool):
        self.spark = spark

    def lit(self, text: str) -> str:
        if self.spark:
            text = text.replace("\\", "\\\\").replace("'", "\\'")
        else:
            text = text.replace("'", "''")
        return f"'{text}'"

    def rx(self, value: str, pattern: str) -> str:
        return f"{'regexp_like' if self.spark else 'regexp_matches'}({value}, {self.lit(pattern)})"

    def sub(self, value: str, pattern: str, by: str) -> str:
        tail = "" if self.spark else ", 'g'"
        return f"regexp_replace({value}, {self.lit(pattern)}, {self.lit(by)}{tail})"

    def find_all(self, value: str, pattern: str) -> str:
        return f"regexp_extract_all({value}, {self.lit(pattern)}, 0)"

    def hash32(self, value: str) -> str:
        if self.spark:
            return f"CAST(conv(substr(md5({value}), 1, 8), 16, 10) AS BIGINT)"
        return f"CAST(concat('0x', substr(md5({value}), 1, 8)) AS BIGINT)"

    def each(self, value: str) -> str:
        return f"explode({value})" if self.spark else f"unnest({value})"

    def quantile(self, value: str, q: float) -> str:
        return f"percentile({value}, {q})" if self.spark else f"quantile_cont({value}, {q})"

    def seconds(self, value: str) -> str:
        return f"unix_micros(CAST({value} AS TIMESTAMP)) / 1000000" if self.spark else f"CAST(epoch_us({value}) AS DOUBLE) / 1000000"

    def joined(self, value: str, order: str) -> str:
        """Values (strings) of a group, in order, joined by +."""
        if self.spark:
            return f"array_join(transform(array_sort(collect_list(struct({order} AS o, {value} AS v))), x -> x.v), '+')"
        return f"string_agg({value}, '+' ORDER BY {order})"

    def hex256(self, value: str) -> str:
        return f"sha2({value}, 256)" if self.spark else f"sha256({value})"


SPARK, CHECK = Dialect(True), Dialect(False)
