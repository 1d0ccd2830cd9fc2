"""XML: parsing to node trees and node tables, serialising, conversion to documents, and analysis.

Parsing is expat's, which checks well-formedness and namespaces' syntax; entity definitions are not expanded. A node is a dict:
_name, and where present _attrs, _ns (prefix to URI, '' for the default), _text or _children (nodes, and {"_text": ...} or {"_cdata": ...} in
mixed content) and _cdata.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framepack.errors import XmlConversionError, XmlParseError
from framepack.sources.grammar import decode
from framepack.sources.writer import encode_value

#: Layout by what a document looks like, with the estimated share of tokens it saves (fixed values).
REDUCTIONS = {"mixed": 25, "compact": 65, "nested": 45, "simple": 40}
#: Elements from which tables pay, depth and number of names from which documents count as complex.
MANY, DEEP, NAMES, ALIKE = 10, 5, 20, 0.75


def is_node(x: Any) -> bool:
    return isinstance(x, dict) and isinstance(x.get("_name"), str)


def is_text(x: Any) -> bool:
    return isinstance(x, dict) and "_name" not in x and ("_text" in x or "_cdata" in x)


def parse(text: str, preserve_whitespace: bool = False, preserve_comments: bool = False, preserve_cdata: bool = True, preserve_instructions: bool = False) -> dict:
    """{version, encoding, standalone, doctype, instructions, comments, root} of a document; parts that are absent are left out."""
    doc: dict[str, Any] = {}
    stack: list[dict] = []
    state = {"cdata": False, "text": ""}
    p = expat.ParserCreate()
    p.buffer_text, p.ordered_attributes = True, True

    def flush() -> None:
        held, state["text"] = state["text"], ""
        if not stack or not held or (not preserve_whitespace and not held.strip()):
            return
        stack[-1]["_children"].append({"_text": held if preserve_whitespace else held.strip()})

    def start(name: str, pairs: list[str]) -> None:
        flush()
        node: dict[str, Any] = {"_name": name, "_children": []}
        for k, v in zip(pairs[::2], pairs[1::2]):
            if k == "xmlns" or k.startswith("xmlns:"):
                node.setdefault("_ns", {})[k[6:]] = v
            else:
                node.setdefault("_attrs", {})[k] = v
        if stack:
            stack[-1]["_children"].append(node)
        else:
            doc["root"] = node
        stack.append(node)

    def end(_: str) -> None:
        flush()
        node = stack.pop()
        parts = node["_children"]
        if not any(is_node(c) for c in parts):
            # Nothing but text: it belongs to the node itself.
            texts = [c for c in parts if "_text" in c]
            sections = [c["_cdata"] for c in parts if "_cdata" in c]
            if not (texts and sections) and len(texts) <= 1:
                del node["_children"]
                if texts:
                    node["_text"] = texts[0]["_text"]
                if sections:
                    node["_cdata"] = "".join(sections)
        if "_children" in node and not node["_children"]:
            del node["_children"]

    def characters(data: str) -> None:
        if state["cdata"]:
            state["held"] = state.get("held", "") + data
        else:
            state["text"] += data

    def cdata_start() -> None:
        if preserve_cdata:
            flush()
            state["cdata"], state["held"] = True, ""

    def cdata_end() -> None:
        if preserve_cdata:
            state["cdata"] = False
            stack[-1]["_children"].append({"_cdata": state.pop("held")})

    def declaration(version: str, encoding: str | None, standalone: int) -> None:
        doc["version"] = version
        if encoding:
            doc["encoding"] = encoding
        if standalone >= 0:
            doc["standalone"] = bool(standalone)

    def doctype(name: str, system: str | None, public: str | None, _: int) -> None:
        doc["doctype"] = {"name": name, **({"public": public} if public else {}), **({"system": system} if system else {})}

    def comment(data: str) -> None:
        if preserve_comments and not stack:
            doc.setdefault("comments", []).append(data)

    def instruction(target: str, data: str) -> None:
        if preserve_instructions and not stack:
            doc.setdefault("instructions", []).append({"target": target, "data": data})

    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, characters
    p.StartCdataSectionHandler, p.EndCdataSectionHandler = cdata_start, cdata_end
    p.XmlDeclHandler, p.StartDoctypeDeclHandler, p.CommentHandler, p.ProcessingInstructionHandler = declaration, doctype, comment, instruction
    p.EntityDeclHandler = lambda *_: _refuse()
    try:
        p.Parse(text.strip().encode("utf-8"), True) if not text.lstrip().startswith("<?xml") else p.Parse(text.strip(), True)
    except expat.ExpatError as e:
        raise XmlParseError(expat.errors.messages.get(e.code, "not well-formed"), e.lineno, e.offset + 1) from None
    return doc


def _refuse() -> None:
    raise XmlParseError("entity definitions are not allowed")


def parse_element(text: str, **options: bool) -> dict:
    return parse(text, **options)["root"]


# -- serialising -----------------------------------------------------------------------------------------------------------------------


def text_entities(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def attribute_entities(s: str) -> str:
    return text_entities(s).replace('"', "&quot;").replace("'", "&apos;")


def serialize_node(node: dict, indent: str = "  ", newline: str = "\n", self_close: bool = True, pretty: bool = True, depth: int = 0) -> str:
    pad, end = (indent * depth, newline) if pretty else ("", "")
    head = node["_name"] + "".join(f' {"xmlns:" + k if k else "xmlns"}="{attribute_entities(v)}"' for k, v in node.get("_ns", {}).items()) + "".join(f' {k}="{attribute_entities(str(v))}"' for k, v in node.get("_attrs", {}).items())
    own = (f"<![CDATA[{node['_cdata']}]]>" if "_cdata" in node else "") + text_entities(str(node.get("_text", "")))
    children = node.get("_children", [])
    if not children:
        return f"{pad}<{head}/>{end}" if self_close and not own and "_text" not in node else f"{pad}<{head}>{own}</{node['_name']}>{end}"
    if own or any(not is_node(c) for c in children):
        inner = own + "".join(serialize_node(c, indent, newline, self_close, False) if is_node(c) else f"<![CDATA[{c['_cdata']}]]>" if "_cdata" in c else text_entities(c["_text"]) for c in children)
        return f"{pad}<{head}>{inner}</{node['_name']}>{end}"
    return f"{pad}<{head}>{end}" + "".join(serialize_node(c, indent, newline, self_close, pretty, depth + 1) for c in children) + f"{pad}</{node['_name']}>{end}"


def serialize(doc: dict, include_declaration: bool = True, newline: str = "\n", **options: Any) -> str:
    out = []
    if include_declaration:
        out.append(f'<?xml version="{doc.get("version", "1.0")}"' + (f' encoding="{doc["encoding"]}"' if doc.get("encoding") else "") + (f' standalone="{"yes" if doc["standalone"] else "no"}"' if "standalone" in doc else "") + "?>")
    if d := doc.get("doctype"):
        out.append(f"<!DOCTYPE {d['name']}" + (f' PUBLIC "{d["public"]}" "{d.get("system", "")}"' if d.get("public") else f' SYSTEM "{d["system"]}"' if d.get("system") else "") + ">")
    out += [f"<?{i['target']} {i['data']}?>" for i in doc.get("instructions", [])] + [f"<!--{c}-->" for c in doc.get("comments", [])]
    return newline.join([*out, serialize_node(doc["root"], newline=newline, **options)])


# -- conversion ------------------------------------------------------------------------------------------------------------------------


def node_to_object(node: dict, prefix: str = "a_") -> dict:
    """The node as a plain object: attributes with a prefix, a child by its name if all names differ, else all in _children."""
    out: dict[str, Any] = {"_name": node["_name"]}
    if node.get("_ns"):
        out["_ns"] = dict(node["_ns"])
    out |= {prefix + k: v for k, v in node.get("_attrs", {}).items()}
    out |= {k: node[k] for k in ("_text", "_cdata") if k in node}
    children = node.get("_children", [])
    names = [c["_name"] for c in children if is_node(c)]
    if children and len(names) == len(children) and len(set(names)) == len(names) and not any(n in out or n.startswith((prefix, "_")) for n in names):
        out |= {c["_name"]: node_to_object(c, prefix) for c in children}
    elif children:
        out["_children"] = [node_to_object(c, prefix) if is_node(c) else dict(c) for c in children]
    return out


def object_to_node(value: dict, prefix: str = "a_") -> dict:
    if not is_node(value):
        raise XmlConversionError("an element needs a _name")
    node: dict[str, Any] = {"_name": value["_name"]}
    children: list = []
    for k, v in value.items():
        if k == "_name":
            continue
        if k in ("_text", "_cdata", "_ns"):
            node[k] = dict(v) if k == "_ns" else v if isinstance(v, str) else str(v)
        elif k == "_children":
            children += [object_to_node(c, prefix) if is_node(c) else {n: str(x) for n, x in c.items()} for c in v]
        elif k.startswith(prefix):
            node.setdefault("_attrs", {})[k[len(prefix) :]] = v if isinstance(v, str) else json.dumps(v)
        elif is_node(v):
            children.append(object_to_node(v, prefix))
        elif v is not None:
            children.append({"_name": k, "_text": v if isinstance(v, str) else json.dumps(v)})
    if children:
        node["_children"] = children
    return node


def xml_to_document(text: str, prefix: str = "a_", **options: bool) -> str:
    """The text document of an XML document; what is absent from the XML is absent there."""
    doc = parse(text, **options)
    head = {"_xml": True} | {f"_{k}": doc[k] for k in ("version", "encoding", "standalone") if k in doc}
    return encode_value({**head, "root": node_to_object(doc["root"], prefix)})


def document_to_xml(text: str, prefix: str = "a_", include_declaration: bool = True, **options: Any) -> str:
    value = decode(text)
    if not isinstance(value, dict):
        raise XmlConversionError("the document is no object")
    root = value.get("root", value)
    doc = {k: value[f"_{k}"] for k in ("version", "encoding", "standalone") if f"_{k}" in value}
    return serialize(doc | {"root": object_to_node(root, prefix)}, include_declaration, **options)


def parse_to_object(text: str, **options: bool) -> dict:
    return node_to_object(parse_element(text, **options))


def object_to_xml(value: dict, **options: Any) -> str:
    return serialize_node(object_to_node(value), **options)


def documents(xml_text: Column) -> Column:
    """The document of each XML text; null stays null."""
    return F.pandas_udf(_documents, "string")(xml_text)


def _documents(texts: pd.Series) -> pd.Series:
    return texts.map(xml_to_document, na_action="ignore")


def texts(document: Column) -> Column:
    """The XML text of each document, without indentation; null stays null."""
    return F.pandas_udf(_texts, "string")(document)


def _texts(documents: pd.Series) -> pd.Series:
    return documents.map(lambda d: document_to_xml(d, pretty=False, newline=""), na_action="ignore")


# -- node tables and analysis ------------------------------------------------------------------------------------------------------------

NODES = "node_id int, parent_id int, pos int, depth int, kind string, name string, attrs map<string,string>, ns map<string,string>, text string"


def _flat(node: dict) -> Iterator[tuple]:
    """Rows of a tree in document order."""
    todo: list = [(node, None, 0, 0)]
    n = 0
    while todo:
        x, parent, pos, depth = todo.pop()
        me, n = n, n + 1
        if not is_node(x):
            kind = "_cdata" if "_cdata" in x else "_text"
            yield (me, parent, pos, depth, kind[1:], None, {}, {}, x[kind])
            continue
        yield (me, parent, pos, depth, "element", x["_name"], x.get("_attrs", {}), x.get("_ns", {}), x.get("_text"))
        parts = ([{"_cdata": x["_cdata"]}] if "_cdata" in x else []) + x.get("_children", [])
        todo += [(c, me, i, depth + 1) for i, c in reversed(list(enumerate(parts)))]


def nodes(df: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """A row for every node of every document: (id, node_id, parent_id, pos, depth, kind, name, attrs, ns, text). Null texts have none."""
    kind = df.schema[id_col].dataType.simpleString()
    names = ["id", *[x.split()[0] for x in NODES.split(", ")]]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(i, *r) for i, t in zip(part["id"], part["xml"]) if t is not None for r in _flat(parse_element(t))]
            yield pd.DataFrame(rows, columns=names).astype({"parent_id": "Int32"})

    return df.select(F.col(id_col).alias("id"), F.col(xml_col).alias("xml")).mapInPandas(run, f"id {kind}, {NODES}").withColumnRenamed("id", id_col)


def mode_of(mixed: Column, uniform: Column, elements: Column, depth: Column, names: Column) -> Column:
    """struct(mode, reduction) by the first rule that fits."""
    pick = lambda mode, key: F.struct(F.lit(mode).alias("mode"), F.lit(REDUCTIONS[key]).alias("reduction"))
    return F.when(mixed, pick("xml-mixed", "mixed")).when(uniform & (elements > MANY), pick("xml-compact", "compact")).when((depth > DEEP) | (names > NAMES), pick("xml-nested", "nested")).when(elements < MANY, pick("xml-nested", "simple")).otherwise(pick("xml-nested", "nested"))


def analysis(tree: DataFrame, id_col: str) -> DataFrame:
    """One row per document of a node table: counts, flags, and the recommended layout. Aggregations and one join of children to parents."""
    element = F.col("kind") == "element"
    # Children of a node by kind, and the signature of each element: its name, attributes, and children's names.
    kids = tree.where("parent_id is not null").groupBy(id_col, F.col("parent_id").alias("node_id")).agg(
        F.sum(F.when(element, 1).otherwise(0)).alias("elements"),
        F.sum(F.when((F.col("kind") == "text") & (F.trim("text") != ""), 1).otherwise(0)).alias("texts"),
        F.sum(F.when(F.col("kind") == "cdata", 1).otherwise(0)).alias("sections"),
        F.array_join(F.array_sort(F.collect_list(F.when(element, F.col("name")))), ",").alias("child_names"),
    )
    full = tree.where(element).join(kids, [id_col, "node_id"], "left").fillna({"elements": 0, "texts": 0, "sections": 0, "child_names": ""})
    signature = F.concat_ws("|", "name", F.array_join(F.array_sort(F.map_keys("attrs")), ","), F.when(F.col("text").isNotNull(), F.lit("text")).otherwise(F.lit("")), F.when(F.col("sections") > 0, F.lit("cdata")).otherwise(F.lit("")), "child_names")
    full = full.withColumn("signature", signature)
    per = full.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("element_count"),
        F.max("depth").alias("max_depth"),
        F.max((F.col("elements") > 0) & ((F.col("texts") > 0) | F.coalesce(F.trim("text") != "", F.lit(False)))).alias("has_mixed_content"),
        F.max(F.col("sections") > 0).alias("has_cdata"),
        F.max(F.size("ns") > 0).alias("has_namespaces"),
        F.max(F.size("attrs") > 0).alias("has_attributes"),
        F.avg("elements").alias("avg_children"),
        F.array_sort(F.collect_set("name")).alias("names"),
        F.min_by("signature", F.when(F.col("depth") == 1, F.col("pos"))).alias("first"),
        F.sum(F.when(F.col("depth") == 1, 1).otherwise(0)).alias("n_children"),
    )
    same = full.where("depth = 1").join(per.select(id_col, "first"), id_col).where("signature = first").groupBy(id_col).agg(F.count(F.lit(1)).alias("n_same"))
    out = per.join(same, id_col, "left").withColumn("has_uniform_children", (F.col("n_children") >= 2) & (F.coalesce("n_same", F.lit(0)) >= ALIKE * F.col("n_children")))
    chosen = mode_of(F.col("has_mixed_content"), F.col("has_uniform_children"), F.col("element_count"), F.col("max_depth"), F.size("names"))
    out = out.withColumn("chosen", chosen)
    return out.select(id_col, "element_count", "max_depth", "has_mixed_content", "has_cdata", "has_namespaces", "has_attributes", "has_uniform_children", "avg_children", "names", F.col("chosen.mode").alias("mode"), F.col("chosen.reduction").alias("reduction"))


def token_reduction(df: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """(id, xml_tokens, document_tokens, reduction): estimated tokens of each XML text and of its document in the recommended layout."""
    from framepack.functions.text import xml_tokens

    found = analysis(nodes(df, id_col, xml_col), id_col).select(id_col, "reduction")
    counted = df.select(id_col, xml_tokens(F.col(xml_col)).alias("xml_tokens")).join(found, id_col)
    return counted.select(id_col, "xml_tokens", F.round(F.col("xml_tokens") * (1 - F.col("reduction") / 100)).cast("long").alias("document_tokens"), "reduction")


def report(found: DataFrame) -> Column:
    """A text report of an analysis' row."""
    line = lambda label, c: F.concat(F.lit(f"{label}: "), found[c].cast("string"))
    return F.concat_ws("\n", F.lit("XML analysis"), line("layout", "mode"), F.concat(F.lit("estimated reduction: "), found["reduction"].cast("string"), F.lit(" %")), line("elements", "element_count"), line("depth", "max_depth"), F.concat(F.lit("average children: "), F.format_string("%.2f", found["avg_children"])), line("mixed content", "has_mixed_content"), line("CDATA", "has_cdata"), line("namespaces", "has_namespaces"), line("attributes", "has_attributes"), line("uniform children", "has_uniform_children"), F.concat(F.lit("names: "), F.array_join(found["names"], ", ")))
