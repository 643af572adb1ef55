"""Macros over packet payloads (BINARY): DNS, TLS, HTTP, IP, Ethernet, ICMP headers."""

MACROS = r"""
q_byte(b BINARY, k INT) BIGINT = CASE WHEN octet_length(b) >= k + 1 THEN CAST(conv(hex(substring(b, k + 1, 1)), 16, 10) AS BIGINT) END
q_short(b BINARY, k INT) BIGINT = CASE WHEN octet_length(b) >= k + 2 THEN CAST(conv(hex(substring(b, k + 1, 2)), 16, 10) AS BIGINT) END
payload_length(b BINARY) INT = octet_length(b)
payload_offset(b BINARY, o INT, n INT) STRING = CASE WHEN o >= 0 AND n >= 0 AND o + n <= octet_length(b) THEN lower(hex(substring(b, o + 1, n))) END
payload_hex_dump(b BINARY, n INT) STRING = trim(regexp_replace(lower(hex(substring(b, 1, n))), '(..)', '$1 '))
payload_contains(b BINARY, p BINARY) BOOLEAN = contains(b, p)
payload_matches(s STRING, p STRING) BOOLEAN = regexp_like(s, p)
dns_is_response(b BINARY) BOOLEAN = q_byte(b, 2) >= 128
dns_response_code(b BINARY) STRING = CASE q_byte(b, 3) & 15 WHEN 0 THEN 'NOERROR' WHEN 1 THEN 'FORMERR' WHEN 2 THEN 'SERVFAIL' WHEN 3 THEN 'NXDOMAIN' WHEN 4 THEN 'NOTIMP' WHEN 5 THEN 'REFUSED' ELSE concat('RCODE_', q_byte(b, 3) & 15) END
dns_question_count(b BINARY) BIGINT = q_short(b, 4)
dns_answer_count(b BINARY) BIGINT = q_short(b, 6)
dns_transaction_id(b BINARY) BIGINT = q_short(b, 0)
tls_version(b BINARY) STRING = CASE q_short(b, 1) WHEN 768 THEN 'SSL 3.0' WHEN 769 THEN 'TLS 1.0' WHEN 770 THEN 'TLS 1.1' WHEN 771 THEN 'TLS 1.2' WHEN 772 THEN 'TLS 1.3' END
tls_record_type(b BINARY) STRING = CASE q_byte(b, 0) WHEN 20 THEN 'ChangeCipherSpec' WHEN 21 THEN 'Alert' WHEN 22 THEN 'Handshake' WHEN 23 THEN 'ApplicationData' ELSE concat('Unknown(', q_byte(b, 0), ')') END
is_tls_client_hello(b BINARY) BOOLEAN = coalesce(q_byte(b, 0) = 22 AND q_byte(b, 5) = 1, if(b IS NULL, NULL, false))
tls_handshake_type(b BINARY) STRING = CASE WHEN q_byte(b, 0) = 22 THEN CASE q_byte(b, 5) WHEN 0 THEN 'HelloRequest' WHEN 1 THEN 'ClientHello' WHEN 2 THEN 'ServerHello' WHEN 4 THEN 'NewSessionTicket' WHEN 11 THEN 'Certificate' WHEN 12 THEN 'ServerKeyExchange' WHEN 13 THEN 'CertificateRequest' WHEN 14 THEN 'ServerHelloDone' WHEN 15 THEN 'CertificateVerify' WHEN 16 THEN 'ClientKeyExchange' WHEN 20 THEN 'Finished' ELSE concat('Unknown(', q_byte(b, 5), ')') END END
q_method() STRING = '^(GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH|TRACE|CONNECT) '
http_method(s STRING) STRING = nullif(regexp_extract(s, q_method(), 1), '')
http_path(s STRING) STRING = CASE WHEN s LIKE '% %' THEN regexp_extract(s, '^[^ ]* ([^ \\r\\n]*)', 1) END
http_header(s STRING, h STRING) STRING = nullif(trim(regexp_extract(split_part(s, '\r\n\r\n', 1), concat('(?im)^\\Q', h, '\\E[ \\t]*:(.*?)\\r?$'), 1)), '')
http_host(s STRING) STRING = http_header(s, 'host')
http_content_type(s STRING) STRING = http_header(s, 'content-type')
http_content_length(s STRING) BIGINT = try_cast(http_header(s, 'content-length') AS BIGINT)
http_user_agent(s STRING) STRING = http_header(s, 'user-agent')
http_status_code(s STRING) BIGINT = try_cast(nullif(regexp_extract(s, '^HTTP/[^ ]* ([0-9]+)', 1), '') AS BIGINT)
http_status_class(i BIGINT) STRING = CASE WHEN i BETWEEN 100 AND 599 THEN concat(i div 100, 'xx') END
http_version(s STRING) STRING = nullif(if(s LIKE 'HTTP/%', regexp_extract(s, '^(HTTP/[^ \\r\\n]*)', 1), regexp_extract(s, '^[^\\r\\n]* (HTTP/[^\\r\\n]*)', 1)), '')
is_http_request(s STRING) BOOLEAN = regexp_like(s, q_method())
is_http_response(s STRING) BOOLEAN = startswith(s, 'HTTP/')
ip_header_length(b BINARY) BIGINT = (q_byte(b, 0) & 15) * 4
ip_ttl(b BINARY) BIGINT = q_byte(b, 8)
ip_total_length(b BINARY) BIGINT = q_short(b, 2)
ip_dscp(b BINARY) BIGINT = shiftright(q_byte(b, 1), 2)
ether_type(b BINARY) STRING = CASE q_short(b, 12) WHEN 2048 THEN 'IPv4' WHEN 2054 THEN 'ARP' WHEN 34525 THEN 'IPv6' WHEN 33024 THEN 'VLAN' WHEN 34887 THEN 'MPLS' WHEN 35020 THEN 'LLDP' ELSE concat('0x', lpad(hex(q_short(b, 12)), 4, '0')) END
vlan_id(b BINARY) BIGINT = CASE WHEN q_short(b, 12) = 33024 THEN q_short(b, 14) & 4095 END
icmp_type(b BINARY) BIGINT = q_byte(b, 0)
icmp_code(b BINARY) BIGINT = q_byte(b, 1)
icmp_parse(b BINARY) STRING = concat(q_byte(b, 0), ':', q_byte(b, 1))
is_icmp_echo(i INT) BOOLEAN = i IN (0, 8)
icmp_type_name(i INT) STRING = CASE i WHEN 0 THEN 'Echo Reply' WHEN 3 THEN 'Destination Unreachable' WHEN 4 THEN 'Source Quench' WHEN 5 THEN 'Redirect' WHEN 8 THEN 'Echo Request' WHEN 9 THEN 'Router Advertisement' WHEN 10 THEN 'Router Solicitation' WHEN 11 THEN 'Time Exceeded' WHEN 12 THEN 'Parameter Problem' WHEN 13 THEN 'Timestamp Request' WHEN 14 THEN 'Timestamp Reply' WHEN 17 THEN 'Address Mask Request' WHEN 18 THEN 'Address Mask Reply' ELSE concat('Type ', i) END
icmp_code_name(t INT, c INT) STRING = CASE WHEN t = 3 THEN coalesce(try_element_at(array('Network Unreachable', 'Host Unreachable', 'Protocol Unreachable', 'Port Unreachable', 'Fragmentation Needed', 'Source Route Failed'), c + 1), concat('Type 3 Code ', c)) WHEN t = 5 AND c BETWEEN 0 AND 3 THEN element_at(array('Redirect Network', 'Redirect Host', 'Redirect TOS Network', 'Redirect TOS Host'), c + 1) WHEN t = 11 AND c BETWEEN 0 AND 1 THEN element_at(array('TTL Exceeded', 'Fragment Reassembly Exceeded'), c + 1) WHEN c = 0 THEN icmp_type_name(t) ELSE concat('Type ', t, ' Code ', c) END
"""
