"""All registered queries and their SQL."""

from shutterlake.plans import asked, flows, indexed, queries, rules, upkeep

QUERIES = queries.QUERIES | flows.QUERIES | asked.QUERIES | indexed.QUERIES | upkeep.QUERIES | rules.QUERIES
SQL = queries.SQL | flows.SQL | asked.SQL | indexed.SQL | upkeep.SQL | rules.SQL
