"""Chat records from documents, orders and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelspark.functions import messages as M
from labelspark.operators import chat as C
from labelspark.operators.labels import encode_classes, label_vocabulary
from labelspark.operators.splits import hash_split
from labelspark.queries.labels import HASH_SPLIT_SQL
from labelspark.queries.registry import PRIORITY, STATUS, query, table

# JSON text with blanks after , and : and ASCII escapes, spelled out character by character.
ASCII_SQL = """array_to_string(list_transform(string_split(cast(to_json({0}) as varchar), ''), lambda c:
  case when unicode(c) between 32 and 126 or c = '' then c
       when unicode(c) < 65536 then '\\u' || printf('%04x', unicode(c))
       else '\\u' || printf('%04x', 55296 + (unicode(c) - 65536) // 1024) ||
            '\\u' || printf('%04x', 56320 + (unicode(c) - 65536) % 1024) end), '')"""


@query("""select doc_id, cast(to_json({'lang': lang, 'source': source, 'n_chars': n_chars, 'text': text}) as varchar) as body
          from documents""")
def combine_columns(spark, folder):
    columns = ["lang", "source", "n_chars", "text"]
    return C.combine_columns(table(spark, folder, "documents"), columns, "body", compact=True)


@query(f"""select doc_id, '{{"lang": ' || {ASCII_SQL.format('lang')} || ', "text": ' || {ASCII_SQL.format('text')} ||
                  ', "n_chars": ' || n_chars || ', "quality": ' || coalesce(cast(quality as varchar), 'null') || '}}' as text
           from documents left join labels using (doc_id)""")
def combine_columns_spaced(spark, folder):
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return C.combine_columns(rows.drop("source", "toxic"), ["lang", "text", "n_chars", "quality"])


@query("""select doc_id, '[{"role":"user","content":' || cast(to_json(text) as varchar) ||
                 '},{"role":"assistant","content":' || cast(to_json(lang) as varchar) || '}]' as messages from documents""")
def to_messages(spark, folder):
    rows = C.to_messages(table(spark, folder, "documents"), "text", "lang", keep="doc_id")
    return rows.select("doc_id", F.to_json("messages").alias("messages"))


@query("select doc_id, text as prompt, lang as completion from documents")
def preprocess_chat(spark, folder):
    documents = table(spark, folder, "documents")
    vocab = label_vocabulary(documents, "lang")
    chat, _ = C.preprocess_chat(encode_classes(documents, "lang", vocab), "text", "lang", encoded=vocab, keep="doc_id")
    return _ends(chat, "doc_id")


@query("""select o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || '}' as prompt,
                 '{"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}' as completion
          from orders""")
def preprocess_chat_multi(spark, folder):
    orders = table(spark, folder, "orders").withColumn("key", F.col("o_orderkey"))
    chat, _ = C.preprocess_chat(orders, ["o_orderkey", "o_custkey"], [PRIORITY, STATUS], keep="key", compact=True)
    return _ends(chat, "key").withColumnRenamed("key", "o_orderkey")


@query(f"""select doc_id, {HASH_SPLIT_SQL.format(key='doc_id')} as split,
                  '{{"source": "' || source || '", "lang": "' || lang || '"}}' as prompt, lang as completion from documents""")
def preprocess_chat_splits(spark, folder):
    rows = hash_split(table(spark, folder, "documents"), 0.2, "doc_id").withColumn("label", F.col("lang"))
    chat, _ = C.preprocess_chat(rows, ["source", "lang"], "label", keep=["doc_id", "split"])
    return _ends(chat, "doc_id", "split")


def _ends(chat, *keys):
    m = F.col("messages")
    return chat.select(*keys, m[0]["content"].alias("prompt"), m[1]["content"].alias("completion"))


def _conversations(spark, folder):
    return C.conversation_messages(table(spark, folder, "conversations"), "conv_id", "turn", "role", "text")


@query("""select conv_id, '[' || string_agg('{"role":' || cast(to_json(role) as varchar) || ',"content":' ||
                 cast(to_json(text) as varchar) || '}', ',' order by turn) || ']' as messages
          from conversations group by 1""")
def conversation_messages(spark, folder):
    return _conversations(spark, folder).select("conv_id", F.to_json("messages").alias("messages"))


@query("""select conv_id, trim(arg_min(text, turn), chr(9) || chr(10) || chr(13) || ' ') as first_text,
                 arg_max(text, turn) as last_text from conversations group by 1""")
def messages_endpoints(spark, folder):
    return C.conversation_ends(table(spark, folder, "conversations"), "conv_id", "turn", "text")


@query("""select conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' order by turn)
                 || '<|im_start|>assistant' || chr(10) as rendered from conversations group by 1""")
def render_chatml(spark, folder):
    rendered = M.render_chatml(F.col("messages"), open_answer=True)
    return _conversations(spark, folder).select("conv_id", rendered.alias("rendered"))


@query("""select conv_id, string_agg('<|' || role || '|>' || chr(10) || text || '</s>' || chr(10), '' order by turn)
                 as rendered from conversations where role in ('user', 'system', 'assistant') group by 1""")
def render_zephyr(spark, folder):
    return _conversations(spark, folder).select("conv_id", M.render_zephyr(F.col("messages")).alias("rendered"))


@query("""select conv_id, turn, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as line from conversations""")
def render_chatml_turns(spark, folder):
    return C.rendered_turns(table(spark, folder, "conversations"), "conv_id", "turn", "role", "text", M.chatml_turn)


@query("""select conv_id, turn, case when role in ('user', 'system', 'assistant') then '<|' || role || '|>' || chr(10) || text || '</s>' || chr(10)
                 else '' end as line from conversations""")
def render_zephyr_turns(spark, folder):
    return C.rendered_turns(table(spark, folder, "conversations"), "conv_id", "turn", "role", "text", M.zephyr_turn)


@query("""select doc_id, 'user' as role, text as content, 1 as n from documents""")
def wrap_user_message(spark, folder):
    m = M.user_message(F.col("text"))
    rows = table(spark, folder, "documents").select("doc_id", m.alias("m"))
    return rows.select("doc_id", F.col("m")[0]["role"].alias("role"), F.col("m")[0]["content"].alias("content"),
                       F.size("m").alias("n"))
