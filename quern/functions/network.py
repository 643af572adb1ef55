"""Macros for addresses, networks, hardware addresses, ports, protocols and TCP flags."""

MACROS = r"""
is_ipv4(s STRING) BOOLEAN = coalesce(s RLIKE '^((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\\.|$)){4}$' AND s NOT LIKE '%.', false)
ip_to_int(s STRING) BIGINT = CASE WHEN is_ipv4(s) THEN aggregate(split(s, '\\.'), 0L, (p, x) -> p * 256 + CAST(x AS BIGINT)) END
int_to_ip(i BIGINT) STRING = CASE WHEN i IS NOT NULL THEN concat_ws('.', shiftright(i, 24) & 255, shiftright(i, 16) & 255, shiftright(i, 8) & 255, i & 255) END
q_six(s STRING) BOOLEAN = coalesce(s RLIKE '^([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$' OR (s RLIKE '^(([0-9A-Fa-f]{1,4}:)*[0-9A-Fa-f]{1,4})?::(([0-9A-Fa-f]{1,4}:)*[0-9A-Fa-f]{1,4})?$' AND size(filter(split(s, ':'), x -> x <> '')) <= 7), false)
is_ipv6(s STRING) BOOLEAN = q_six(s) OR coalesce(is_ipv4(regexp_extract(s, ':([0-9.]+)$', 1)) AND q_six(regexp_replace(s, '[0-9.]+$', '0:0')), false)
ip_version(s STRING) INT = CASE WHEN is_ipv4(s) THEN 4 WHEN is_ipv6(s) THEN 6 END
q_wrap(i BIGINT) BIGINT = i & 4294967295
q_bits(c STRING) INT = CASE WHEN c RLIKE '^[^/]+/[0-9]{1,3}$' THEN try_cast(split_part(c, '/', 2) AS INT) END
prefix_length(c STRING) INT = q_bits(c)
q_mask(n INT) BIGINT = CASE WHEN n BETWEEN 0 AND 32 THEN q_wrap(shiftleft(4294967295L, 32 - n)) END
q_low(c STRING) BIGINT = ip_to_int(split_part(c, '/', 1)) & q_mask(q_bits(c))
q_high(c STRING) BIGINT = q_low(c) | q_wrap(~q_mask(q_bits(c)))
cidr_contains(c STRING, s STRING) BOOLEAN = ip_to_int(s) BETWEEN q_low(c) AND q_high(c)
cidr_overlap(a STRING, b STRING) BOOLEAN = q_low(a) <= q_high(b) AND q_low(b) <= q_high(a)
network_address(c STRING) STRING = int_to_ip(q_low(c))
ip_subnet(c STRING) STRING = int_to_ip(q_low(c))
ip_netmask(c STRING) STRING = int_to_ip(q_mask(q_bits(c)))
broadcast_address(c STRING) STRING = int_to_ip(q_high(c))
cidr_to_range(c STRING) STRING = concat(int_to_ip(q_low(c)), '-', int_to_ip(q_high(c)))
hosts_in_cidr(c STRING) BIGINT = CASE q_bits(c) WHEN 32 THEN 1 WHEN 31 THEN 2 ELSE shiftleft(1L, 32 - q_bits(c)) - 2 END
mask_ip(s STRING, n INT) STRING = int_to_ip(ip_to_int(s) & q_mask(32 - 8 * n))
ip_in_range(s STRING, a STRING, b STRING) BOOLEAN = ip_to_int(s) BETWEEN ip_to_int(a) AND ip_to_int(b)
ip_between(s STRING, a STRING, b STRING) BOOLEAN = ip_to_int(s) BETWEEN ip_to_int(a) AND ip_to_int(b)
same_subnet(a STRING, b STRING, n INT) BOOLEAN = (ip_to_int(a) & q_mask(n)) = (ip_to_int(b) & q_mask(n))
ip_add(s STRING, n BIGINT) STRING = int_to_ip(q_wrap(ip_to_int(s) + n))
ip_subtract(s STRING, n BIGINT) STRING = int_to_ip(q_wrap(ip_to_int(s) - n))
ip_diff(a STRING, b STRING) BIGINT = ip_to_int(a) - ip_to_int(b)
ip_to_hex(s STRING) STRING = lower(lpad(hex(ip_to_int(s)), 8, '0'))
is_private_ip(s STRING) BOOLEAN = coalesce(cidr_contains('10.0.0.0/8', s) OR cidr_contains('172.16.0.0/12', s) OR cidr_contains('192.168.0.0/16', s), CASE WHEN is_ipv6(s) THEN lower(s) RLIKE '^f[cd][0-9a-f]{2}:' END)
is_loopback_ip(s STRING) BOOLEAN = coalesce(cidr_contains('127.0.0.0/8', s), CASE WHEN is_ipv6(s) THEN s RLIKE '^[0:]*:0{0,3}1$' END)
is_multicast_ip(s STRING) BOOLEAN = coalesce(cidr_contains('224.0.0.0/4', s), CASE WHEN is_ipv6(s) THEN lower(s) RLIKE '^ff[0-9a-f]{2}:' END)
is_link_local_ip(s STRING) BOOLEAN = coalesce(cidr_contains('169.254.0.0/16', s), CASE WHEN is_ipv6(s) THEN lower(s) RLIKE '^fe[89ab][0-9a-f]:' END)
is_reserved_ip(s STRING) BOOLEAN = is_private_ip(s) OR is_loopback_ip(s) OR is_multicast_ip(s) OR is_link_local_ip(s)
q_mac(s STRING) STRING = CASE WHEN lower(regexp_replace(s, '[:.\\-]', '')) RLIKE '^[0-9a-f]{12}$' THEN lower(regexp_replace(s, '[:.\\-]', '')) END
mac_format(s STRING, d STRING) STRING = array_join(transform(sequence(1, 11, 2), k -> substr(q_mac(s), k, 2)), d)
mac_to_string(s STRING) STRING = mac_format(s, ':')
mac_vendor_oui(s STRING) STRING = upper(left(mac_format(s, ':'), 8))
q_mac_first(s STRING) BIGINT = CAST(conv(left(q_mac(s), 2), 16, 10) AS BIGINT)
mac_is_unicast(s STRING) BOOLEAN = (q_mac_first(s) & 1) = 0
mac_is_local(s STRING) BOOLEAN = (q_mac_first(s) & 2) <> 0
ipv6_to_eui64(s STRING) STRING = lower(concat(lpad(hex(q_mac_first(s) ^ 2), 2, '0'), substr(q_mac(s), 3, 2), ':', substr(q_mac(s), 5, 2), 'ff:fe', substr(q_mac(s), 7, 2), ':', substr(q_mac(s), 9, 4)))
-- Fixed values: names of ports and protocol numbers, fixed by the functions' contract.
port_name(p INT) STRING = CASE p WHEN 20 THEN 'ftp-data' WHEN 21 THEN 'ftp' WHEN 22 THEN 'ssh' WHEN 23 THEN 'telnet' WHEN 25 THEN 'smtp' WHEN 53 THEN 'dns' WHEN 67 THEN 'dhcp' WHEN 68 THEN 'dhcp-client' WHEN 80 THEN 'http' WHEN 110 THEN 'pop3' WHEN 123 THEN 'ntp' WHEN 143 THEN 'imap' WHEN 161 THEN 'snmp' WHEN 162 THEN 'snmp-trap' WHEN 443 THEN 'https' WHEN 445 THEN 'smb' WHEN 465 THEN 'smtps' WHEN 514 THEN 'syslog' WHEN 587 THEN 'submission' WHEN 636 THEN 'ldaps' WHEN 993 THEN 'imaps' WHEN 995 THEN 'pop3s' WHEN 1433 THEN 'mssql' WHEN 1521 THEN 'oracle' WHEN 3306 THEN 'mysql' WHEN 3389 THEN 'rdp' WHEN 5432 THEN 'postgresql' WHEN 5900 THEN 'vnc' WHEN 6379 THEN 'redis' WHEN 8080 THEN 'http-alt' WHEN 8443 THEN 'https-alt' WHEN 9200 THEN 'elasticsearch' WHEN 27017 THEN 'mongodb' END
is_well_known_port(p INT) BOOLEAN = p BETWEEN 0 AND 1023
is_registered_port(p INT) BOOLEAN = p BETWEEN 1024 AND 49151
is_ephemeral_port(p INT) BOOLEAN = p BETWEEN 49152 AND 65535
port_class(p INT) STRING = CASE WHEN p BETWEEN 0 AND 1023 THEN 'well-known' WHEN p BETWEEN 1024 AND 49151 THEN 'registered' WHEN p BETWEEN 49152 AND 65535 THEN 'ephemeral' END
protocol_name(n INT) STRING = CASE n WHEN 1 THEN 'icmp' WHEN 2 THEN 'igmp' WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' WHEN 41 THEN 'ipv6' WHEN 47 THEN 'gre' WHEN 50 THEN 'esp' WHEN 51 THEN 'ah' WHEN 58 THEN 'icmpv6' WHEN 89 THEN 'ospf' WHEN 103 THEN 'pim' WHEN 132 THEN 'sctp' END
protocol_number(s STRING) BIGINT = CASE lower(s) WHEN 'icmp' THEN 1 WHEN 'igmp' THEN 2 WHEN 'tcp' THEN 6 WHEN 'udp' THEN 17 WHEN 'ipv6' THEN 41 WHEN 'gre' THEN 47 WHEN 'esp' THEN 50 WHEN 'ah' THEN 51 WHEN 'icmpv6' THEN 58 WHEN 'ospf' THEN 89 WHEN 'pim' THEN 103 WHEN 'sctp' THEN 132 END
q_flags() ARRAY<STRING> = array('FIN', 'SYN', 'RST', 'PSH', 'ACK', 'URG', 'ECE', 'CWR')
tcp_flags_to_string(f INT) STRING = CASE WHEN f IS NOT NULL THEN array_join(filter(transform(q_flags(), (x, k) -> if(getbit(f, k) = 1, x, NULL)), x -> x IS NOT NULL), ',') END
tcp_flags_from_string(s STRING) BIGINT = aggregate(split(upper(s), ','), 0L, (p, x) -> p | if(array_contains(q_flags(), trim(x)), shiftleft(1L, CAST(array_position(q_flags(), trim(x)) AS INT) - 1), 0L))
has_tcp_flag(f INT, s STRING) BOOLEAN = (f & tcp_flags_from_string(s)) <> 0
is_tcp_handshake(f INT) BOOLEAN = (f & 2) <> 0 AND (f & 16) = 0
is_tcp_reset(f INT) BOOLEAN = (f & 4) <> 0
tcp_session_id(a STRING, p INT, b STRING, q INT, proto INT) STRING = if(a < b OR (a = b AND p <= q), concat(a, ':', p, '-', b, ':', q, '/', proto), concat(b, ':', q, '-', a, ':', p, '/', proto))
flow_direction(a STRING, b STRING) STRING = CASE WHEN is_private_ip(a) AND is_private_ip(b) THEN 'internal' WHEN is_private_ip(a) THEN 'outbound' WHEN is_private_ip(b) THEN 'inbound' WHEN a IS NOT NULL AND b IS NOT NULL THEN 'transit' END
"""
