"""Sources and sinks: model tables (parquet / JDBC / derived fixtures), CSV sinks."""

from growret.sources.model import MODEL_SCHEMAS, check_schema, load_model_tables
from growret.sources.store import forget, model_tables, refresh, store_model_tables

__all__ = ["MODEL_SCHEMAS", "check_schema", "forget", "load_model_tables", "model_tables", "refresh", "store_model_tables"]
