"""The queries of this subpackage, one or more per operator, and their SQL where SQL can express them."""

from cartolith.llm import bytepairs, chat, exact, html, lines, packing, periods, quality, sentencepieces, simhash, toxicity, urls, vectorcodes

_MODULES = (html, exact, urls, quality, packing, sentencepieces, simhash, toxicity, chat, lines, periods, bytepairs, vectorcodes)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: text for module in _MODULES for name, text in module.SQL.items()}
