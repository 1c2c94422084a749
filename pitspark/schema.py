"""The observation envelope, its payloads, and checks of both."""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = "1.0"


class DataClass(IntEnum):
    PUBLIC_AGGREGATE = 0
    PUBLIC_TEXT = 1
    LICENSED = 2


_S, _L = T.StringType(), T.LongType()


OBSERVATION = T.StructType(
    [
        T.StructField("observation_id", _S, False), T.StructField("schema_version", _S, False), T.StructField("signal_type", _S, False), T.StructField("series_id", _S, False),
        T.StructField("run_id", _S, False), T.StructField("source_id", _S, False), T.StructField("adapter_id", _S, False), T.StructField("security_id", _S), T.StructField("native_entity", _S, False),
        T.StructField("event_time_ns", _L, False), T.StructField("knowledge_time_ns", _L, False), T.StructField("ingest_time_ns", _L, False), T.StructField("vintage_id", _S, False),
        T.StructField("data_class", T.ByteType(), False), T.StructField("license_tag", _S, False), T.StructField("derived_by", _S), T.StructField("payload", _S, False), T.StructField("raw", T.BinaryType()),
    ]
)
COLUMNS = OBSERVATION.fieldNames()
#: Strings that must hold something.
REQUIRED_TEXT = tuple("license_tag native_entity adapter_id source_id run_id signal_type schema_version observation_id".split())

#: Fields of each payload as DDL, in the order of canonical JSON.
PAYLOADS: dict[str, str] = {
    "social.sentiment": "magnitude double, model struct<model_id:string,version:string>, sample_size bigint, score double",
    "social.attention": "mention_count bigint, share_of_voice double, unique_authors bigint, velocity double",
    "attention.search_interest": "geo string, interest double, rescale_basis string",
    "attention.hiring": "geo string, mom_change double, open_reqs bigint, role_class string",
    "fundamental.fact": "concept string, period_end string, period_type string, unit string, value double",
    "event.filing": "accession string, amends_ref string, form_type string, items array<string>",
    "environment.weather_anomaly": "deviation_vs_climatology double, forecast_horizon double, georef string, metric string",
    "geo.activity_index": "georef string, processing_vintage string, provider string, value double",
    "market.bar": "adjustment_ref string, close double, high double, low double, open double, volume double, vwap double",
    "market.corporate_action": "action_type string, amount double, ex_date string, pay_date string, ratio double, record_date string",
    "market.delisting": "final_value_policy string, last_trade_date string, reason string",
    "meta.coverage": "entities_covered bigint, gap_marker boolean, note string, source_up boolean",
}
#: The field that a factor reads where it names none.
DEFAULT_FIELD = {"social.sentiment": "score", "social.attention": "velocity", "attention.search_interest": "interest", "attention.hiring": "open_reqs", "fundamental.fact": "value", "environment.weather_anomaly": "deviation_vs_climatology", "geo.activity_index": "value", "market.bar": "close"}


class SchemaError(ValueError):
    """A row or payload breaks the schema."""


class SchemaRegistry:
    """Payload types by signal type; extensions may be added, standard types not replaced."""

    def __init__(self) -> None:
        self._types = dict(PAYLOADS)

    def signal_types(self) -> list[str]:
        return sorted(self._types)

    def register_extension(self, signal_type: str, payload: str) -> None:
        if not signal_type or signal_type in self._types:
            raise SchemaError(f"{signal_type!r} is empty or taken")
        self._types[signal_type] = payload

    def payload(self, signal_type: str) -> str | None:
        """None: a generic payload, a map of fields."""
        return self._types.get(signal_type)

    def decode(self, rows: DataFrame, signal_type: str) -> DataFrame:
        """Rows of one signal type with the payload parsed, as ``fields``; generic: map of JSON texts."""
        kind = self.payload(signal_type)
        parsed = F.from_json("payload", kind) if kind else F.from_json("payload", "map<string,string>")
        return rows.where(F.col("signal_type") == signal_type).withColumn("fields", parsed)


@dataclass(frozen=True)
class ModelRef:
    """``model@version``, split at the first @."""

    model_id: str
    version: str

    def __post_init__(self) -> None:
        if not self.model_id or not self.version:
            raise SchemaError("a model has an id and a version")

    @classmethod
    def parse(cls, text: str) -> ModelRef:
        if "@" not in text:
            raise SchemaError(f"{text!r} names no version")
        return cls(*text.split("@", 1))

    def __str__(self) -> str:
        return "@".join((self.model_id, self.version))


def invalid_reason() -> Column:
    """Why an envelope is invalid: the first required text that is null or empty; null: valid."""
    tests = [F.when(F.coalesce(F.length(c), F.lit(0)) == 0, F.lit(f"{c} is empty")) for c in REQUIRED_TEXT]
    tests += [F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c in ("series_id", "vintage_id", "event_time_ns", "knowledge_time_ns", "ingest_time_ns", "data_class", "payload")]
    # a payload of a standard type has no fields but those of the type
    by_type = {kind: [f.split(" ")[0] for f in _split(ddl)] for kind, ddl in PAYLOADS.items()}
    fields = F.create_map(*(x for kind, names in by_type.items() for x in (F.lit(kind), F.array(*map(F.lit, names)))))
    foreign = F.array_except(F.json_object_keys("payload"), F.try_element_at(fields, F.col("signal_type")))
    tests.append(F.when(F.col("signal_type").isin(*by_type) & (F.json_object_keys("payload").isNull() | (F.size(foreign) > 0)), F.lit("payload is not one of its signal type")))
    return F.coalesce(*tests)


def _split(ddl: str) -> list[str]:
    """Fields of a DDL, at the commas outside brackets."""
    out, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def conform(rows: DataFrame) -> DataFrame:
    """The columns of an observation in order; a table from before series ids gets empty ones."""
    if "series_id" not in rows.columns:
        rows = rows.withColumn("series_id", F.lit(""))
    return rows.select(*((F.coalesce("series_id", F.lit("")) if f.name == "series_id" else F.col(f.name)).cast(f.dataType).alias(f.name) for f in OBSERVATION))
