"""Every operator as a query over the driver tables, with the SQL that must give the same rows."""
