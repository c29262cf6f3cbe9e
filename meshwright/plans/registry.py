"""All registered queries of the geometric engine and their SQL."""

from . import l1, site, walls, whole

QUERIES = {**l1.QUERIES, **walls.QUERIES, **site.QUERIES, **whole.QUERIES}
SQL = {**l1.SQL, **walls.SQL, **site.SQL, **whole.SQL}
