"""Naming rules of the profile and vocabularies of the masks; every list can be replaced."""

from __future__ import annotations

from dataclasses import dataclass

# Name patterns that decide a field's class, in the order in which they are tried.
SCD2 = ("eff_sdt", "eff_edt", "eff_strt_dt", "eff_end_dt", "eff_start_date", "eff_end_date", "logc_del_ind")
CONTROL = ("etl_", "dw_load", "dw_updt", "rec_seq", "cyc_dt", "proc_cd", "src_cd", "ctl_rec", "publ_id", "chkum", "newline")
PII_NAME = ("_nm", "_name", "first_nm", "last_nm", "mid_init", "_prefix", "_suffix", "_title", "ceo_")
PII_ADDRESS = ("_addr", "_street", "_city", "_state", "_zip", "_mail_", "_phys_", "str_addr", "cty_nm", "st_abbr")
PII_PHONE = ("_phone", "_area_cd", "_exchng", "_ext_nbr", "bus_area", "bus_exchng")
PII_ID = ("ssn", "tax_id", "ein", "passport")
KEY_ENDS = ("_id", "_nbr", "_number", "_cd", "_key")
# Name patterns of the mask routes.
MASK_ROUTES = (
    ("CITY", ("city", "cty")),
    ("STREET_ADDRESS", ("street", "addr")),
    ("PERSON_NAME", ("name", "nm")),
    ("STATE", ("state", "st_abbr")),
    ("ZIP", ("zip", "postal")),
    ("PHONE", ("phone", "tel")),
    ("EMAIL", ("email",)),
    ("SSN", ("ssn",)),
)
# Key names that mean the same, date columns by preference, and keys checked for blanks.
CONCEPTS = (
    ("business", ("business_id", "bus_nbr", "mtch_bus_nbr", "mtch_hq_bus_nbr", "ultimate_bus_id", "hq_bus_id", "parent_bus_id")),
    ("etl", ("etl_cyc_dt", "etl_proc_cd", "etl_cyc_id")),
)
DATE_COLUMNS = ("bus_cyc_dt", "eff_strt_dt", "eff_sdt", "etl_cyc_dt")
RELATED_ENDS = ("_id", "_nbr", "_number")
CHECKED_KEYS = ("_id", "_nbr", "business_id", "bus_nbr", "addr_match_nbr")

FIRST_NAMES = ("Ada", "Bela", "Cleo", "Dario", "Edda", "Falk", "Gwen", "Hugo", "Iris", "Jory", "Kaja", "Lio", "Mira", "Nils", "Oona", "Piet")
LAST_NAMES = ("Amberg", "Birken", "Calder", "Dunmore", "Ellery", "Fenwick", "Garrow", "Hollis", "Ingram", "Jessop", "Kestrel", "Lindow", "Marlow", "Norrby", "Ostler", "Penrose")
STREETS = ("Alder Lane", "Brook Street", "Cedar Way", "Dale Road", "Elm Court", "Ferry Street", "Grove Avenue", "Hill Road")
CITIES = ("Ashport", "Brindle", "Corvale", "Dunwick", "Eastmere", "Farrow", "Glenhaven", "Harlow Point", "Irondale", "Kingsmoor")
STATES = tuple("AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY".split())


@dataclass(frozen=True)
class Rules:
    """The naming rules of one run."""

    scd2: tuple[str, ...] = SCD2
    control: tuple[str, ...] = CONTROL
    pii_name: tuple[str, ...] = PII_NAME
    pii_address: tuple[str, ...] = PII_ADDRESS
    pii_phone: tuple[str, ...] = PII_PHONE
    pii_id: tuple[str, ...] = PII_ID
    key_ends: tuple[str, ...] = KEY_ENDS
    mask_routes: tuple[tuple[str, tuple[str, ...]], ...] = MASK_ROUTES
    concepts: tuple[tuple[str, tuple[str, ...]], ...] = CONCEPTS
    date_columns: tuple[str, ...] = DATE_COLUMNS
    related_ends: tuple[str, ...] = RELATED_ENDS
    checked_keys: tuple[str, ...] = CHECKED_KEYS
    #: Removed from the front of a key's name before names are compared, such as ``l_`` of a table.
    strip_prefix: str = ""

    @property
    def pii(self) -> tuple[str, ...]:
        return self.pii_name + self.pii_address + self.pii_phone + self.pii_id
