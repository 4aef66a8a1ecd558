"""groupsight: behavioural analytics over group -> session -> event data, on Spark."""
