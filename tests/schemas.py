"""Schemas of the fixture tables, as listed in FIXTURES.md, and layout and DDL texts made from them."""

import re
from pathlib import Path

ROWS = {}
for section in re.split(r"\n### `", Path(__file__).parent.parent.joinpath("FIXTURES.md").read_text())[1:]:
    name = section.split("`", 1)[0]
    ROWS[name] = [[c.strip() for c in line.strip("|").split("|")] for line in section.splitlines() if re.match(r"\| \d+ \|", line)]


def layout(table: str, db: str = "FIN", typed: bool = False) -> str:
    lines = [f"/* DML Generated for SQL: select a,\nb\nfrom\n{db}.{table.upper()}\n * On: Mon Mar 10 09:30:15 2025\n */"] if not typed else [f"type {table.upper()}_T ="]
    lines.append("record")
    for _, column, declared, _, required, *_ in ROWS[table]:
        base = "date" if declared == "DATE" else "datetime" if declared.startswith("TIMESTAMP") else "string" if "CHAR" in declared else "decimal"
        size = re.search(r"\((\d+)", declared)
        params = {"date": '("YYYY-MM-DD")("\\x01")', "datetime": '("YYYY-MM-DD HH24:MI:SS.NNNNNN")("\\x01")', "decimal": '("\\x01")', "string": f'("\\x01", maximum_length={size and size[1]})'}[base]
        null = "" if required == "yes" else ' = NULL("")'
        lines.append(f"  {base}{params} {column}{null} /*{declared}{' NOT NULL' if required == 'yes' else ''}*/;")
    lines += ['  string(1) newline = "\\n";', "end", ";" if typed else ""]
    return "\n".join(lines + ([f"metadata type = {table.upper()}_T\n;"] if typed else []))


def ddl(table: str, db: str = "fin", index: str = "UNIQUE PRIMARY INDEX PK ( A ,B )") -> str:
    columns = [f"      {c.upper()} {d}{' CHARACTER SET LATIN NOT CASESPECIFIC' if 'CHAR' in d else ''}{' NOT NULL' if r == 'yes' else ''}" for _, c, d, _, r, *_ in ROWS[table]]
    body = ",\n".join(columns)
    return f"CREATE MULTISET TABLE {db}.{table} ,FALLBACK ,\n     NO BEFORE JOURNAL,\n     MAP = M1\n     (\n{body})\n{index};\n"
