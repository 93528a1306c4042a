"""Set-at-a-time operators: graph rewrites, filters, joins, roll-ups, scans."""
