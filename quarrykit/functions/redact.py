"""Secrets in nested columns, told by the names of fields, never by values."""

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType, VariantType

#: Names of fields that hold secrets.
NAMES = ("api_key", "apikey", "token", "secret", "password", "authorization")
MASK = "***"


def _secret(name: Column) -> Column:
    return F.lower(name).isin(*NAMES)


def masked(value: Column, kind: DataType) -> Column:
    """value with secrets masked at any depth of structs, arrays, maps and variants. A secret field becomes text; in a map, whose values have one type, it becomes
    null where that type isn't text. A struct with a list loc that names a secret has its field input masked: so do errors of validation tell what was wrong."""
    if isinstance(kind, StructType):
        out = []
        named = next((f for f in kind.fields if f.name.lower() == "loc" and isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StringType)), None)
        for f in kind.fields:
            own = value[f.name]
            if f.name.lower() in NAMES:
                own = F.when(own.isNotNull(), F.lit(MASK))
            elif f.name == "input" and named:
                told = F.coalesce(F.exists(value[named.name], lambda x: F.coalesce(_secret(x), F.lit(False))), F.lit(False))
                same = isinstance(f.dataType, StringType)
                own = F.when(told & own.isNotNull(), F.lit(MASK)).otherwise(own if same else F.to_json(own) if isinstance(f.dataType, (StructType, ArrayType, MapType)) else own.cast("string"))
            else:
                own = masked(own, f.dataType)
            out.append(own.alias(f.name))
        return F.when(value.isNotNull(), F.struct(*out))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: masked(x, kind.elementType))
    if isinstance(kind, MapType):
        hidden = F.lit(MASK) if isinstance(kind.valueType, StringType) else F.lit(None)
        if not isinstance(kind.keyType, StringType):
            return F.transform_values(value, lambda k, v: masked(v, kind.valueType))
        return F.transform_values(value, lambda k, v: F.when(_secret(k), hidden).otherwise(masked(v, kind.valueType)))
    if isinstance(kind, VariantType):
        return F.try_parse_json(masked_json(F.to_json(value)))
    return value


def redacted(df: DataFrame) -> DataFrame:
    """df with secrets masked in all columns, themselves among the fields."""
    return df.select(*(F.when(F.col(f"`{f.name}`").isNotNull(), F.lit(MASK)).alias(f.name) if f.name.lower() in NAMES else masked(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema))


def _hide(value, name: str | None = None):
    if name is not None and name.lower() in NAMES:
        return MASK
    if isinstance(value, dict):
        told = isinstance(value.get("loc"), list) and any(isinstance(x, str) and x.lower() in NAMES for x in value["loc"])
        return {k: MASK if told and k == "input" else _hide(v, k) for k, v in value.items()}
    return [_hide(x) for x in value] if isinstance(value, list) else value


def _masked_texts(texts: pd.Series) -> pd.Series:
    def one(text):
        try:
            return None if text is None else json.dumps(_hide(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    return pd.Series([one(t) for t in texts], dtype=object)


def masked_json(text: Column) -> Column:
    """JSON with secrets masked; what is no JSON gives null, as nothing is known of it."""
    return F.pandas_udf(_masked_texts, StringType(), F.PandasUDFType.SCALAR)(text)
