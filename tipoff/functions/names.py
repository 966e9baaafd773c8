"""Column functions of names: slugs, short names, titles, coaches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings that a short name leaves out, and names that are short as a whole.
MASCOTS = (
    "Wildcats|Tigers|Bulldogs|Eagles|Bears|Cougars|Panthers|Hawks|Wolverines|Spartans|Hoosiers|Boilermakers|Hawkeyes|Jayhawks|Mountaineers|Cavaliers|Volunteers|Crimson Tide|Blue Devils|Tar Heels|Demon Deacons"
    "|Fighting Irish|Nittany Lions|Golden Gophers|Scarlet Knights|Cardinal|Bruins|Huskies|Ducks|Beavers|Trojans|Rebels|Razorbacks|Aggies|Longhorns|Seminoles|Hurricanes|Commodores|Colonels|Hilltoppers"
    "|Horned Frogs|Mustangs|Rams|Knights|Gaels|Friars|Musketeers|Bearcats|Red Storm|Peacocks|Orange|Orangemen|Terrapins|Terps|Badgers|Buckeyes|Sooners|Cowboys|Miners|Zags"
)
SHORT = {"UConn Huskies": "UConn", "UNLV Rebels": "UNLV", "LSU Tigers": "LSU", "USC Trojans": "USC", "SMU Mustangs": "SMU", "TCU Horned Frogs": "TCU", "VCU Rams": "VCU", "UCF Knights": "UCF", "UCLA Bruins": "UCLA", "BYU Cougars": "BYU"}
#: Endings that a suggested slug leaves out, the first that fits.
SLUG_ENDINGS = "Wildcats|Tar Heels|Spartans|Hoosiers|Boilermakers|Aggies|Nittany Lions|Badgers|Gophers|Hawkeyes|Cyclones|Jayhawks|Sooners|Cowboys|Eagles|Tigers|Lions|Bears|Bruins|Trojans|Mountaineers|Longhorns|Utes|Aztecs|Demons|Gamecocks"
#: Fixed value: a name that two coaches bear, by end year of the season.
TWO_OF_A_NAME = ("John Thompson", 2000, "John Thompson Jr.", "John Thompson III")


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")


def suggested_slug(name: Column) -> Column:
    """A guess: no mascot, no ampersand or apostrophe, single hyphens."""
    bare = F.regexp_replace(name, f"\\s*({SLUG_ENDINGS})$", "")
    dashed = F.regexp_replace(F.replace(F.lower(bare), F.lit(" "), F.lit("-")), "[&']", "")
    return F.array_join(F.filter(F.split(dashed, "-"), lambda p: p != ""), "-")


def school_name(name: Column, mascot: Column) -> Column:
    return F.replace(name, F.concat(F.lit(" "), mascot), F.lit(""))


def short_name(name: Column) -> Column:
    """Without a known mascot, else the first word."""
    special = F.element_at(F.create_map(*(F.lit(x) for kv in SHORT.items() for x in kv)), name)
    bare = F.regexp_replace(name, f" ({MASCOTS})$", "")
    return F.coalesce(special, F.when(bare != name, bare).otherwise(F.split(name, " ")[0]))


def title_of_slug(text: Column) -> Column:
    return F.initcap(F.replace(text, F.lit("-"), F.lit(" ")))


def one_coach(name: Column, end_year: Column) -> Column:
    """The name of one person: names that two bear are told apart by the year."""
    shared, cutoff, before, after = TWO_OF_A_NAME
    return F.when(name == shared, F.when(end_year >= cutoff, after).otherwise(before)).otherwise(name)


def escaped(text: Column) -> Column:
    """Text for an HTML attribute."""
    for a, b in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
