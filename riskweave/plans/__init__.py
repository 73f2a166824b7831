"""Query plans over the driver tables, each with the SQL an oracle can run on the same tables."""
