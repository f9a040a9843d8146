"""The rule language: force fields, residue templates, mappings and citations, parsed on the driver into a catalog.

Rule data is small (thousands of lines); it becomes plain records, and tables
where a plan joins with it. Sections are written [ name ]; ';' starts a
comment; macros are $names; attributes are JSON.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from latticework.functions.predicates import Choice, NotDefinedOrNot

#: Atoms of each interaction of a force field file; exclusions and virtual_sitesn take any number.
ATOMS_OF = {"bonds": 2, "angles": 3, "dihedrals": 4, "impropers": 4, "constraints": 2, "pairs": 2, "pairs_nb": 2, "SETTLE": 1, "virtual_sites2": 3, "virtual_sites3": 4, "virtual_sites4": 5, "position_restraints": 1, "distance_restraints": 2, "dihedral_restraints": 4, "orientation_restraints": 2, "angle_restraints": 4, "angle_restraints_z": 2, "cmap": 5}
PARAM_FUNCTIONS = {"dist": 2, "angle": 3, "dihedral": 4, "dihphase": 4}
#: The eight numbers of a residue file's defaults.
BONDED_DEFAULTS = (1, 1, 1, 1, 0, 3, 1, 1)
PREFIXES = "+-><*"


@dataclass
class Interaction:
    atoms: tuple[str, ...]
    params: tuple[object, ...] = ()
    meta: dict = field(default_factory=dict)


@dataclass
class Template:
    """A block, link or modification: nodes (name -> attributes), edges, interactions by type."""

    kind: str
    name: str = ""
    nrexcl: int | None = None
    nodes: dict[str, dict] = field(default_factory=dict)
    edges: list[tuple[str, str]] = field(default_factory=list)
    interactions: dict[str, list[Interaction]] = field(default_factory=dict)
    removed: dict[str, list[Interaction]] = field(default_factory=dict)
    non_edges: list[tuple[str, dict]] = field(default_factory=list)
    patterns: list[list[tuple[str, dict]]] = field(default_factory=list)
    features: set[str] = field(default_factory=set)
    molmeta: dict = field(default_factory=dict)
    meta: dict = field(default_factory=dict)
    citations: set[str] = field(default_factory=set)
    log: dict[str, list[str]] = field(default_factory=dict)

    def edges_from_interactions(self, types: tuple[str, ...] = ("bonds", "constraints", "angles", "dihedrals", "cmap")) -> None:
        for t in types:
            for i in self.interactions.get(t, ()):
                if i.meta.get("edge", True):
                    for a, b in zip(i.atoms, i.atoms[1:]):
                        if (a, b) not in self.edges and (b, a) not in self.edges:
                            self.edges.append((a, b))


@dataclass
class ForceField:
    name: str
    blocks: dict[str, Template] = field(default_factory=dict)
    links: list[Template] = field(default_factory=list)
    modifications: dict[str, Template] = field(default_factory=dict)
    variables: dict[str, object] = field(default_factory=dict)
    citations: dict[str, dict] = field(default_factory=dict)

    @property
    def features(self) -> set[str]:
        return set().union(*[x.features for x in self.links]) if self.links else set()

    def has_feature(self, name: str) -> bool:
        return name in self.features

    def __eq__(self, other) -> bool:
        return isinstance(other, ForceField) and self.name == other.name

    def __hash__(self) -> int:
        return hash(self.name)

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """block_atom, block_edge and block_interaction, small enough to be broadcast."""
        atoms = [(b.name, i, n, a.get("atype"), a.get("resname"), a.get("resid"), a.get("charge_group"), a.get("charge"), a.get("mass")) for b in self.blocks.values() for i, (n, a) in enumerate(b.nodes.items())]
        edges = [(b.name, *e) for b in self.blocks.values() for e in b.edges]
        inter = [(b.name, t, list(i.atoms), [str(p) for p in i.params], json.dumps(i.meta)) for b in self.blocks.values() for t, held in b.interactions.items() for i in held]
        return {
            "block_atom": spark.createDataFrame(atoms, "resname string, ord int, atomname string, atype string, atom_resname string, resid int, charge_group int, charge double, mass double"),
            "block_edge": spark.createDataFrame(edges, "resname string, a string, b string"),
            "block_interaction": spark.createDataFrame(inter, "resname string, itype string, atoms array<string>, params array<string>, meta string"),
        }


# --- lines and tokens -----------------------------------------------------------------------------------------------


def strip_comment(line: str, mark: str = ";") -> str:
    quoted = False
    for i, c in enumerate(line):
        if c == '"':
            quoted = not quoted
        elif c == mark and not quoted:
            return line[:i].strip()
    return line.strip()


def tokens(line: str) -> list[str]:
    """Words; a {...} or (...) group and a quoted text stay together, also right after a word."""
    out, word, depth, quoted = [], "", 0, False
    for c in line:
        if c == '"':
            quoted = not quoted
        elif not quoted and c in "{(":
            if c == "{" and not depth and word:
                out.append(word)
                word = ""
            depth += 1
        elif not quoted and c in "})":
            depth -= 1
        if c.isspace() and not depth and not quoted:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
            if c == "}" and not depth and not quoted:
                out.append(word)
                word = ""
    if depth or quoted:
        raise ValueError(f"unclosed bracket or quote: {line!r}")
    return [*out, word] if word else out


def sections(text: str, nested: dict[str, set[str]] | None = None) -> Iterator[tuple[str, str, int]]:
    """(section, line, number) of every line with content, macros filled in; a header alone gives an empty line."""
    macros: dict[str, str] = {}
    section = ""
    for number, raw in enumerate(text.splitlines(), 1):
        line = strip_comment(raw)
        if not line:
            continue
        if line.startswith("[") and line.endswith("]"):
            section = re.sub(r"\s+", " ", line[1:-1].strip())
            if section != "macros":
                yield section, "", number
            continue
        if section == "macros":
            name, value = tokens(line)
            macros[name] = value[1:-1] if value[:1] == '"' else value
            continue
        yield section, re.sub(r"\$(\w+)", lambda m: _macro(macros, m[1], number), line), number


def _macro(macros: dict[str, str], name: str, number: int) -> str:
    if name not in macros:
        raise KeyError(f"line {number}: unknown macro {name}")
    value = macros[name]
    return json.dumps(value) if "|" in value else value


def attribute(value):
    """A template value: a|b is a choice, not("x") a negation."""
    if isinstance(value, str):
        m = re.fullmatch(r'not\("?(.*?)"?\)', value)
        if m:
            return NotDefinedOrNot(m[1])
        if "|" in value:
            return Choice(tuple(value.split("|")))
    return value


def attributes(token: str) -> dict:
    token = re.sub(r'(:\s*)not\(\s*"?([^")]*)"?\s*\)', r'\1"not(\2)"', token)
    return {k: attribute(v) for k, v in json.loads(token).items()}


def split_prefix(name: str, given: dict | None = None) -> tuple[str, dict]:
    """(key, attributes) of a link atom: leading + - > < * give its order; the key keeps the prefix."""
    attrs = dict(given or {})
    m = re.match(rf"([{re.escape(PREFIXES)}]*)(.+)", name)
    prefix, bare = m[1], m[2]
    if prefix:
        if len(set(prefix)) > 1:
            raise ValueError(f"mixed prefix: {name}")
        order = {"+": len(prefix), "-": -len(prefix)}.get(prefix[0], prefix)
        if attrs.get("order", order) != order:
            raise ValueError(f"{name} disagrees with order {attrs['order']}")
        attrs["order"] = order
    elif "order" in attrs:
        o = attrs["order"]
        name = (o if isinstance(o, str) else ("+" if o > 0 else "-") * abs(o)) + bare
    else:
        attrs["order"] = 0
    attrs.setdefault("atomname", bare)
    return name, attrs


@dataclass(frozen=True)
class ParamFunction:
    """dist(a,b), angle(a,b,c), dihedral(..) or dihphase(..) of atoms, with an optional number format."""

    name: str
    atoms: tuple[str, ...]
    fmt: str | None = None

    def column(self, point: Callable[[str], list]):
        from pyspark.sql import functions as F

        from latticework.functions import geometry as geo

        f = {"dist": geo.distance, "angle": geo.angle, "dihedral": geo.dihedral, "dihphase": geo.dihedral_phase}[self.name]
        value = f(*[point(a) for a in self.atoms])
        value = value if self.name == "dist" else F.degrees(value)
        return F.format_string("%" + self.fmt, value) if self.fmt else value.cast("string")


def parameter(token: str):
    m = re.fullmatch(r"(\w+)\(([^)|]*)(?:\|([^)]*))?\)", token)
    if m and m[1] in PARAM_FUNCTIONS:
        atoms = tuple(a.strip() for a in m[2].split(","))
        if len(atoms) != PARAM_FUNCTIONS[m[1]]:
            raise ValueError(f"{token}: takes {PARAM_FUNCTIONS[m[1]]} atoms")
        return ParamFunction(m[1], atoms, m[3])
    return token


# --- force field files ----------------------------------------------------------------------------------------------


def _atom_tokens(words: list[str], n: int | None) -> tuple[list[tuple[str, dict]], list[str]]:
    """Atoms (with attributes right after them) and what follows; '--' ends the atoms."""
    atoms, i = [], 0
    while i < len(words) and (n is None or len(atoms) < n):
        if words[i] == "--":
            i += 1
            break
        given = attributes(words[i + 1]) if i + 1 < len(words) and words[i + 1].startswith("{") and (n is not None or i + 2 < len(words)) else None
        atoms.append((words[i], given or {}))
        i += 1 + (given is not None)
    if i < len(words) and words[i] == "--":
        i += 1
    if n is not None and len(atoms) < n:
        raise ValueError(f"not enough atoms: {words}")
    return atoms, words[i:]


def _node(t: Template, name: str, given: dict) -> str:
    if t.kind == "block":
        name = list(t.nodes)[int(name) - 1] if name.isdigit() and name not in t.nodes else name
        if name not in t.nodes:
            raise KeyError(f"{t.name}: no atom {name}")
        return name
    key, attrs = split_prefix(name, given)
    held = t.nodes.setdefault(key, {})
    for k, v in attrs.items():
        if k in held and held[k] != v and k in given:
            raise ValueError(f"{key}: two values of {k}")
        held.setdefault(k, v)
    return key


def read_ff(text: str, ff: ForceField) -> ForceField:
    """Adds the blocks, links, modifications, variables and citations of a force field file."""
    now: Template | None = None
    section_meta: dict = {}
    last = ""
    for section, line, number in sections(text):
        if not line:
            section_meta = {}
            if section == "link":
                now = Template("link")
                ff.links.append(now)
            elif section in ("moleculetype", "modification"):
                now = None
            last = section
            continue
        words = tokens(line)
        if section == "variables":
            ff.variables[words[0]] = _number(words[1])
        elif section == "citations" or (section == "citation" and now is None):
            ff.citations.update({w: {} for w in words})
        elif section == "moleculetype":
            now = Template("block", words[0], int(words[1]) if len(words) > 1 else None)
            ff.blocks[now.name] = now
        elif section == "modification":
            now = Template("modification", words[0])
            ff.modifications[now.name] = now
        elif now is None:
            raise ValueError(f"line {number}: [ {last} ] stands outside a block, link or modification")
        elif line.startswith("#meta"):
            section_meta = json.loads(line[5:])
        else:
            _template_line(now, section, words, line, section_meta)
    for t in [*ff.blocks.values(), *ff.links, *ff.modifications.values()]:
        t.edges_from_interactions()
    return ff


def _number(word: str):
    for kind in (int, float):
        try:
            return kind(word)
        except ValueError:
            pass
    return word.strip('"')


def _template_line(t: Template, section: str, words: list[str], line: str, section_meta: dict) -> None:
    if section == "atoms" and t.kind == "block":
        _, atype, resid, resname, name, group, *rest = words
        extra = attributes(rest.pop()) if rest and rest[-1].startswith("{") else {}
        t.nodes[name] = {"atomname": name, "atype": atype, "resid": int(resid), "resname": resname, "charge_group": int(group)} | {k: float(v) for k, v in zip(("charge", "mass"), rest)} | extra
    elif section == "atoms":
        key, attrs = split_prefix(words[0], attributes(words[1]) if len(words) > 1 else {})
        if t.kind == "modification":
            attrs.setdefault("PTM_atom", False)
        t.nodes.setdefault(key, {}).update(attrs)
    elif section in ("edges", "non-edges"):
        atoms, _ = _atom_tokens(words, 2)
        if section == "edges":
            t.edges.append(tuple(_node(t, *a) for a in atoms))
        else:
            t.non_edges.append((_node(t, *atoms[0]), split_prefix(*atoms[1])[1]))
    elif section == "patterns":
        t.patterns.append([split_prefix(*a) for a in _atom_tokens(words, None)[0]])
    elif section == "features":
        t.features.update(words)
    elif section == "citation":
        t.citations.update(words)
    elif section in ("debug", "info", "warning", "error"):
        t.log.setdefault(section, []).append(line)
    elif section in ("meta", "molmeta"):
        (t.meta if section == "meta" else t.molmeta)[words[0]] = attribute(_number(words[1])) if len(words) > 1 else True
    elif section in ("resname", "link") or (t.kind == "link" and len(words) == 2 and section not in ATOMS_OF and section != "exclusions"):
        pass
    else:
        remove = section.startswith("!")
        name = section.lstrip("!")
        if name not in ATOMS_OF and name not in ("exclusions", "virtual_sitesn"):
            raise KeyError(f"unknown section {section}")
        meta = dict(section_meta)
        atoms, rest = _atom_tokens(words, ATOMS_OF.get(name))
        if rest and rest[-1].startswith("{"):
            meta |= json.loads(rest.pop())
        params = tuple(parameter(w) for w in rest)
        if name == "dihedrals" and params and params[0] == "2":
            name = "impropers"
        made = Interaction(tuple(_node(t, *a) for a in atoms), params, meta)
        (t.removed if remove else t.interactions).setdefault(name, []).append(made)


# --- residue files --------------------------------------------------------------------------------------------------


def read_rtp(text: str, ff: ForceField) -> ForceField:
    """Residue templates; what reaches into a neighbour (+ or - atoms) becomes a link."""
    defaults, residue, part = BONDED_DEFAULTS, None, ""
    for section, line, _ in sections(text):
        if section == "bondedtypes":
            if line:
                given = [int(w) for w in line.split()]
                defaults = (*given, *BONDED_DEFAULTS[len(given):])
                ff.variables["bondedtypes"] = defaults
            continue
        if not line:
            if section in ("atoms", "bonds", "angles", "dihedrals", "impropers", "cmap", "exclusions") and residue is not None:
                part = section
            else:
                residue, part = Template("block", section, defaults[5]), ""
                ff.blocks[section] = residue
            continue
        words = line.split()
        if part == "atoms":
            residue.nodes[words[0]] = {"atomname": words[0], "atype": words[1], "charge": float(words[2]), "charge_group": int(words[3]), "resname": residue.name, "resid": 1}
        elif part:
            n = ATOMS_OF.get(part, 2)
            kind = {"bonds": 0, "angles": 1, "dihedrals": 2, "impropers": 3}.get(part)
            made = Interaction(tuple(words[:n]), ((str(defaults[kind]),) if kind is not None else ()) + tuple(words[n:]))
            residue.interactions.setdefault(part, []).append(made)
    for b in list(ff.blocks.values()):
        _split_links(b, ff)
        b.edges_from_interactions(("bonds",))
    return ff


def _split_links(b: Template, ff: ForceField) -> None:
    for kind, held in list(b.interactions.items()):
        own, reach = [], []
        for i in held:
            (own if all(a in b.nodes for a in i.atoms) else reach).append(i)
        b.interactions[kind] = own
        for i in reach:
            if not any(a[0] in "+-" for a in i.atoms):
                continue
            link = Template("link", interactions={kind: [i]})
            for a in i.atoms:
                key, attrs = split_prefix(a)
                if attrs["order"] == 0:
                    attrs["resname"] = b.name
                link.nodes[key] = attrs
            for x, y in zip(i.atoms, i.atoms[1:]):
                link.edges.append((x, y))
            ff.links.append(link)


# --- citations ------------------------------------------------------------------------------------------------------


def read_bib(text: str) -> dict[str, dict[str, str]]:
    """key -> fields of every entry of a BibTeX file."""
    out = {}
    for m in re.finditer(r"@(\w+)\s*\{\s*([^,\s]+)\s*,", text):
        fields, at = {"type": m[1].lower()}, m.end()
        while f := re.compile(r"\s*(\w+)\s*=\s*").match(text, at):
            i = f.end()
            if text[i] in '{"':
                close, depth, j = {"{": "}", '"': '"'}[text[i]], 1, i + 1
                while j < len(text) and depth:
                    depth += text[j] == "{" and text[i] == "{"
                    depth -= text[j] == close
                    j += 1
                value, at = text[i + 1 : j - 1], j
            else:
                v = re.compile(r"[^,}\s]+").match(text, i)
                value, at = v[0], v.end()
            fields[f[1].lower()] = re.sub(r"\s+", " ", value).strip()
            at = re.compile(r"\s*,?").match(text, at).end()
        out[m[2]] = fields
    return out


def citation_line(c: dict[str, str], title: bool = False) -> str:
    parts = [c.get("author", "").replace(" and ", ", ")]
    if title and c.get("title"):
        parts.append(c["title"])
    parts += [c[k] for k in ("journal", "year") if c.get(k)]
    if c.get("doi"):
        parts.append("doi:" + c["doi"])
    return "; ".join(p for p in parts if p)


# --- mappings -------------------------------------------------------------------------------------------------------


@dataclass
class Mapping:
    """Weights from source atoms to target beads; both are (residue number, atom name)."""

    ff_from: str
    ff_to: str
    names: tuple[str, ...]
    kind: str = "block"
    nodes_from: dict[tuple[int, str], dict] = field(default_factory=dict)
    edges_from: list[tuple] = field(default_factory=list)
    nodes_to: dict[tuple[int, str], dict] = field(default_factory=dict)
    weights: dict[tuple[int, str], dict[tuple[int, str], float]] = field(default_factory=dict)
    references: dict[tuple[int, str], tuple[int, str]] = field(default_factory=dict)

    def normalised(self) -> Mapping:
        total: dict = {}
        for to in self.weights.values():
            for b, w in to.items():
                total[b] = total.get(b, 0) + w
        for to in self.weights.values():
            for b in to:
                to[b] = to[b] / total[b] if total[b] else to[b]
        return self

    def reverse(self) -> dict:
        out: dict = {}
        for a, to in self.weights.items():
            for b, w in to.items():
                out.setdefault(b, {})[a] = w
        return out

    def rows(self) -> list[tuple]:
        order = {b: i for i, b in enumerate(dict.fromkeys(b for to in self.weights.values() for b in to))}
        return [(self.names[min(r, len(self.names)) - 1] if self.names else "", a, b, float(w), order[rb, b]) for (r, a), to in self.weights.items() for (rb, b), w in to.items()]


def mapping_table(spark: SparkSession, mappings: list[Mapping]) -> DataFrame:
    return spark.createDataFrame([r for m in mappings for r in m.rows()], "resname string, atomname string, bead string, weight double, bead_order int")


def read_map(text: str, defaults: tuple[str, str] = ("universal", "")) -> list[Mapping]:
    """Legacy block mappings (`defaults`: the force fields of a block that names none): an atom's listed beads share it by how often each is listed; !bead weighs nothing."""
    out, name, froms, tos = [], "", [defaults[0]], [defaults[1]]
    now: Mapping | None = None
    for section, line, _ in sections(text):
        words = line.split()
        if not line:
            if section == "molecule":
                froms, tos, now = [defaults[0]], [defaults[1]], None
            elif section in ("from", "to"):
                (froms if section == "from" else tos).clear()
            elif section == "atoms":
                now = None
            continue
        if section == "molecule":
            name = words[0]
        elif section == "from":
            froms += words
        elif section == "to":
            tos += words
        elif section == "atoms":
            if now is None:
                now = Mapping(froms[0], tos[0], (name,))
                out.append(now)
                out += [(Mapping(f, t, (name,), weights=now.weights)) for f in froms for t in tos if (f, t) != (froms[0], tos[0])]
            _, atom, *beads = words
            listed = [b for b in beads if not b.startswith("!")]
            held = {(1, b): listed.count(b) / len(listed) for b in listed}
            now.weights[1, atom] = held | {(1, b[1:]): 0.0 for b in beads if b.startswith("!")}
    return out


def read_mapping(text: str) -> list[Mapping]:
    """Mappings in sections: molecule or block or modification, from, to, from/to blocks, nodes, edges, mapping, reference atoms."""
    out: list[Mapping] = []
    now: Mapping | None = None
    names: dict[str, dict[str, int]] = {}
    current = {"from": 1, "to": 1}

    def place(side: str, word: str) -> tuple[int, str]:
        if ":" in word:
            res, word = word.split(":", 1)
            current[side] = names.get(side, {}).get(res) or (int(res) if res.isdigit() else current[side])
        return current[side], word

    for section, line, number in sections(text):
        if not line:
            if section in ("block", "molecule", "modification"):
                now = Mapping("", "", (), "modification" if section == "modification" else "block")
                out.append(now)
                names, current = {}, {"from": 1, "to": 1}
            else:
                current = {"from": 1, "to": 1}
            continue
        if now is None:
            raise ValueError(f"line {number}: no mapping is open")
        words = tokens(line)
        side = "from" if section.startswith("from") else "to"
        if section == "from":
            now.ff_from = words[0]
        elif section == "to":
            now.ff_to = words[0]
        elif section.endswith("blocks"):
            for w in (x for x in words if not x.startswith("{")):
                bare = w.lstrip("!")
                res, _, number_ = bare.partition("#")
                held = names.setdefault(side, {})
                held[bare] = held[res] = int(number_) if number_ else len(set(held.values())) + 1
                if side == "from":
                    now.names += (res,)
        elif section.endswith("nodes"):
            given = attributes(words[1]) if len(words) > 1 and words[1].startswith("{") else {}
            p = place(side, words[0])
            (now.nodes_from if side == "from" else now.nodes_to)[p] = {"atomname": p[1]} | given
        elif section.endswith("edges"):
            if side == "from":
                now.edges_from.append((place(side, words[0]), place(side, words[1])))
        elif section == "mapping":
            a, b = place("from", words[0]), place("to", words[1])
            now.weights.setdefault(a, {})[b] = now.weights.get(a, {}).get(b, 0) + (float(words[2]) if len(words) > 2 else 1.0)
        elif section == "reference atoms":
            now.references[place("to", words[0])] = place("from", words[1])
    return [m.normalised() for m in out]


def self_mappings(ff: ForceField) -> list[Mapping]:
    """Every block and modification onto itself."""
    return [Mapping(ff.name, ff.name, (t.name,), "block" if t.kind == "block" else "modification", dict(((1, n), a) for n, a in t.nodes.items()), [], {}, {(1, n): {(1, n): 1.0} for n in t.nodes}) for t in [*ff.blocks.values(), *ff.modifications.values()]]


def combine(known: dict[tuple[str, str], dict[tuple, Mapping]], new: list[Mapping]) -> dict:
    """Later mappings of the same force fields and names take the place of earlier ones."""
    for m in new:
        known.setdefault((m.ff_from, m.ff_to), {})[m.names] = m
    return known


# --- catalogs -------------------------------------------------------------------------------------------------------


def read_force_field(folder: str | Path) -> ForceField:
    """All rule files of a folder, in order of name."""
    folder = Path(folder)
    ff = ForceField(folder.name)
    for p in sorted(folder.iterdir()):
        if p.suffix == ".ff":
            read_ff(p.read_text(encoding="utf-8"), ff)
        elif p.suffix == ".rtp":
            read_rtp(p.read_text(encoding="utf-8"), ff)
        elif p.suffix == ".bib":
            ff.citations.update(read_bib(p.read_text(encoding="utf-8")))
    return ff


def find_force_fields(folder: str | Path) -> dict[str, ForceField]:
    return {p.name: read_force_field(p) for p in sorted(Path(folder).iterdir()) if p.is_dir() and any(x.suffix in (".ff", ".rtp") for x in p.iterdir())}


@cache
def named_force_field(folder: str, name: str) -> ForceField:
    return read_force_field(Path(folder) / name)


def read_mappings(folder: str | Path) -> dict:
    known: dict = {}
    for p in sorted(Path(folder).rglob("*")):
        if p.suffix == ".map":
            combine(known, read_map(p.read_text(encoding="utf-8")))
        elif p.suffix == ".mapping":
            combine(known, read_mapping(p.read_text(encoding="utf-8")))
    return known
