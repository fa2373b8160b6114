"""JSON, array and date scalars over service responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PART = "struct<type:string,text:string>"
BODY = f"struct<output_text:string,output:array<struct<type:string,content:array<{_PART}>>>>"
BATCH_LINE = f"struct<custom_id:string,response:struct<status_code:int,body:{BODY}>,error:string>"
CANDIDATES = "struct<candidates:array<struct<content:struct<parts:array<struct<text:string>>>>>>"
TASK_RESULT = "struct<status_code:int,tasks:array<struct<status_code:int,result:array<struct<se_results_count:bigint>>>>>"
CLAIMS = "map<string,array<struct<mainsnak:struct<datavalue:struct<value:struct<id:string>>>>>>"


def output_text(body: Column) -> Column:
    """output_text, else the message parts of type output_text or text, joined."""
    messages = F.filter(body["output"], lambda o: o["type"] == "message")
    parts = F.filter(F.flatten(F.transform(messages, lambda o: F.coalesce(o["content"], F.array().cast(f"array<{_PART}>")))), lambda p: p["type"].isin("output_text", "text"))
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")
    return F.coalesce(F.when(body["output_text"] != "", body["output_text"]), joined, F.lit(""))


def candidate_text(json: Column) -> Column:
    """D3: the text of the first candidate's parts, joined."""
    first = F.get(F.from_json(json, CANDIDATES)["candidates"], F.lit(0))
    return F.coalesce(F.array_join(F.transform(first["content"]["parts"], lambda p: F.coalesce(p["text"], F.lit(""))), ""), F.lit(""))


def message_content(json: Column) -> Column:
    """D4"""
    return F.coalesce(F.get_json_object(json, "$.choices[0].message.content"), F.lit(""))


def error_text(error: Column, status: Column, body: Column) -> Column:
    """The error object, else the body of a status from 400."""
    return F.coalesce(F.when(F.length(error) > 0, error), F.when(status >= 400, body), F.lit(""))


def hit_count(json: Column, missing: int | None = None) -> Column:
    """Results count guarded by the two status codes; missing replaces a null count."""
    r = F.from_json(json, TASK_RESULT)
    task = F.get(r["tasks"], F.lit(0))
    count = F.get(task["result"], F.lit(0))["se_results_count"]
    return F.when((r["status_code"] == 20000) & (task["status_code"] == 20000), count if missing is None else F.coalesce(count, F.lit(missing)))


def claim_id(json: Column, prop: str) -> Column:
    """Value id of a property's first claim."""
    return F.get(F.from_json(json, CLAIMS)[prop], F.lit(0))["mainsnak"]["datavalue"]["value"]["id"]


def label(json: Column, language: str = "en") -> Column:
    return F.from_json(json, "map<string,struct<value:string>>")[language]["value"]


def n_tokens(tokens: Column) -> Column:
    """D8"""
    return F.coalesce(F.size(tokens), F.lit(0))


def reversed_name(name: Column) -> Column:
    """D9"""
    return F.array_join(F.reverse(F.split(name, " ")), " ")


def utc_seconds(ts: Column) -> Column:
    """A timestamp as ISO text to the second."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
