"""Named queries over the driver tables, and the SQL they are checked against."""
