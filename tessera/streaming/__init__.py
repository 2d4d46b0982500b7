"""The dialect has no streaming operators; a streaming DataFrame can be registered
as a table and queried with the stateless part of the dialect."""
