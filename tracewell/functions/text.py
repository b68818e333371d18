"""Node text: labels, messages, display names and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens of a padded text: runs of word characters with inner punctuation, else single signs.
TOKEN = r"([\p{L}\p{N}_]+(?:[-'.][\p{L}\p{N}_]+)*|[^\s\p{L}\p{N}_])"


def text_or_none(c: Column) -> Column:
    """Nulls appear as the text None."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def node_hash(uuid: Column) -> Column:
    return F.sha2(uuid, 256)


def node_label(node_type: Column, columns: dict[str, Column], features: dict[str, list[str]], hashed: bool = True) -> Column:
    """The configured features of the node's type, in order, joined by blanks; 'type' stands for the type itself."""
    out = None
    for kind, names in features.items():
        parts = [node_type if n == "type" else text_or_none(columns[n]) for n in names]
        joined = F.concat_ws(" ", *parts)
        out = F.when(node_type == kind, joined) if out is None else out.when(node_type == kind, joined)
    return F.sha2(out, 256) if hashed else out


def node_message(node_type: Column, path: Column, cmd: Column, address: Column, port: Column, use_cmd: bool = True, use_port: bool = True) -> Column:
    """Remote address (and port) of a netflow, path (and command) of a subject, path of a file."""
    subject = F.concat_ws(" ", text_or_none(path), text_or_none(cmd)) if use_cmd else text_or_none(path)
    netflow = F.concat_ws(":", text_or_none(address), text_or_none(port)) if use_port else text_or_none(address)
    return F.when(node_type == "subject", subject).when(node_type == "netflow", netflow).otherwise(text_or_none(path))


def node_display(node_type: Column, path: Column, cmd: Column, src_addr: Column, src_port: Column, dst_addr: Column, dst_port: Column) -> Column:
    """``src:port->dst:port`` of a netflow; the path, or the command if there is none, of a subject; the path of a file."""
    flow = F.concat(text_or_none(src_addr), F.lit(":"), text_or_none(src_port), F.lit("->"), text_or_none(dst_addr), F.lit(":"), text_or_none(dst_port))
    none = path.isNull() | (path == "None")
    return F.when(node_type == "netflow", flow).when((node_type == "subject") & none, text_or_none(cmd)).otherwise(text_or_none(path))


def tokenize_path(text: Column) -> Column:
    """Runs of backslashes become slashes, slashes are padded, then words and signs."""
    padded = F.regexp_replace(F.regexp_replace(text, r"\\+", "/"), "/", " / ")
    return F.regexp_extract_all(padded, F.lit(TOKEN))


def tokenize_netflow(text: Column) -> Column:
    padded = F.regexp_replace(F.regexp_replace(text, ":", " : "), r"\.", " . ")
    return F.filter(F.split(F.trim(padded), r"\s+"), lambda t: t != "")


def tokenize_nodes(node_type: Column, message: Column, use_node_types: bool = False) -> Column:
    tokens = F.when(node_type == "netflow", tokenize_netflow(message)).otherwise(tokenize_path(message))
    return F.concat(F.array(node_type), tokens) if use_node_types else tokens


def split_filename(name: Column) -> Column:
    """Struct (words, extension): the last part after a dot, and the words before it joined by blanks."""
    parts = F.split(name, r"\.")
    stem = F.when(F.size(parts) > 1, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    words = F.array_join(F.filter(F.split(F.array_join(stem, "."), r"[^\p{L}\p{N}]+"), lambda w: w != ""), " ")
    return F.struct(words.alias("words"), F.when(F.size(parts) > 1, F.element_at(parts, -1)).alias("extension"))


def hash_list(*columns: Column) -> Column:
    """A 64-bit hash of a row of strings."""
    return F.xxhash64(*columns)
