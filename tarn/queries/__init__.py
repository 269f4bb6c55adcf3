"""The reference's operators applied to the driver's tables, each with the SQL it is held against."""
