"""No streaming operators: every capability covered here is a batch computation."""
