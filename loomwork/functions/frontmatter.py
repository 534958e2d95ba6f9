"""Front matter of Markdown: metadata and body. Fences, name and description are SQL expressions; YAML needs Python."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

# fixed values: the patterns of fences, name and description. (?d): only \n ends a line; (?U): Unicode white space
FENCED = r"(?dsU)\A---\s*\r?\n(.*?)\r?\n---\s*(?:\r?\n|\z)"
OPENED = r"(?dsU)\A---\s*\r?\n(.*)"
NAME = r"(?dmU)^name:\s*(.+)$"
DESCRIPTION = r"(?dmsU)^description:\s*(.*?)(?=\n\w[\w -]*:|\n---|\z)"
OWN = {"name": NAME, "description": DESCRIPTION}

#: How values of a YAML type read as text; the others, flags and containers among them, read as JSON.
PLAIN = {
    "null": lambda v: "",
    "str": str,
    "int": str,
    "float": str,
    "binary": str,
    "set": str,
    "timestamp": lambda v: v.isoformat(),
}


def texts_of(blocks: pd.Series) -> pd.Series:
    """YAML mappings with all values as text; a block that is anything else, or no YAML, is an empty mapping."""
    import yaml

    class Texts(yaml.SafeLoader):
        def read(self) -> dict[str, str]:
            root = self.get_single_node()
            if not isinstance(root, yaml.MappingNode):
                return {}
            self.flatten_mapping(root)
            return {str(self.construct_object(key, deep=True)): self.as_text(value) for key, value in root.value}

        def as_text(self, node: yaml.Node) -> str:
            value = self.construct_object(node, deep=True)
            write = PLAIN.get(node.tag.rpartition(":")[2])
            return write(value) if write else json.dumps(value, ensure_ascii=False, sort_keys=True, default=str)

    def read(block: str) -> dict[str, str]:
        try:
            return Texts(block).read()
        except (yaml.YAMLError, ValueError, TypeError):
            return {}

    return blocks.map(read)


def parse(raw: Column) -> Column:
    """struct<metadata: map<string,string>, body: string> of a raw document; null reads as empty.

    The block between two `---` fences is YAML and the text behind them the body. Behind a lone opening fence all is
    YAML and the body empty. Without fences the whole text is tried as YAML: if it is a mapping the body is empty, else
    it is the text. Byte-order marks at the start are ignored. The keys name and description always exist: what stands
    on the first unindented `name:` line, or from the first unindented `description:` to the next key, a fence or the
    end, wins over the YAML, however broken that is.
    """
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), "^\uFEFF+", "")
    closed, opened = text.rlike(FENCED), text.rlike(OPENED)
    block = F.when(
        closed, F.regexp_extract(text, FENCED, 1)
    ).when(opened, F.regexp_extract(text, OPENED, 1)).otherwise("")
    behind = F.when(closed, F.substr(text, F.char_length(F.regexp_extract(text, FENCED, 0)) + 1)).otherwise("")
    yaml_block = F.pandas_udf(texts_of, "map<string,string>")(F.when(block != "", block).otherwise(text))

    def with_own(m: Column) -> Column:
        found = {k: F.nullif(tx.trim(F.regexp_extract(text, pattern, 1)), F.lit("")) for k, pattern in OWN.items()}
        own = [x for k, v in found.items() for x in (F.lit(k), F.coalesce(v, F.try_element_at(m, F.lit(k)), F.lit("")))]
        meta = F.map_concat(F.create_map(*own), F.map_filter(m, lambda k, _: ~k.isin(*OWN)))
        body = F.when(block != "", behind).when(F.size(m) > 0, "").otherwise(text)
        return F.struct(meta.alias("metadata"), body.alias("body"))

    # a one-element array binds the mapping, so that the YAML is read once
    return F.get(F.transform(F.array(yaml_block), with_own), 0)
